"""Labels get their terms from all documents."""

from lakeloom import plans


def test_documents_of_odd_ids_name_the_terms_of_their_label_too(spark, tmp_path):
    rows = [(1, "maison jardin", "fr"), (3, "maison fleur", "fr"), (2, "house garden", "en"), (5, "house lawn", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'web' as source").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.id, r.label, r.shared) for r in plans.load()[0]["j34_recommended_labels"](spark, str(tmp_path)).collect()}
    assert got == {(1, "fr", 2), (3, "fr", 2), (2, "en", 2), (5, "en", 2)}
