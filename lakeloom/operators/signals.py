"""Signals of texts and speech as column expressions, and the aggregates over them.

Word lists and rule tables are parameters; those given here are defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, tokens
from ..functions.vectors import ratio

#: Default rules of the conversation categories, in order: words, phrases.
CONVERSATION_RULES = (
    ("question", ("what", "why", "how", "when", "where", "who", "which"), ()),
    ("request", ("please", "request"), ("can you", "could you", "would you")),
    ("action_item", ("todo", "assign", "follow"), ("action item", "next step")),
    ("decision", ("decide", "decided", "decision", "choose", "chosen"), ("we will go with",)),
    ("commitment", ("promise", "commit", "committed"), ("i will", "we will")),
    ("status", ("status", "progress", "done", "finished", "blocked"), ()),
    ("summary", ("summary", "overall", "recap"), ("in short", "to sum up")),
    ("plan", ("plan", "roadmap", "schedule", "milestone"), ()),
    ("idea", ("idea", "suggest", "maybe", "perhaps"), ()),
    ("agreement", ("agree", "yes", "exactly", "right"), ()),
    ("disagreement", ("disagree", "no", "however", "but"), ()),
    ("clarification", ("clarify", "mean", "means"), ()),
    ("reference", ("see", "link", "document", "source"), ()),
    ("issue", ("issue", "problem", "bug", "error", "fail"), ()),
)


def hits(words: Column, listed: tuple[str, ...]) -> Column:
    """How many words of an array are listed."""
    return F.size(F.filter(words, lambda w: w.isin(*listed)))


def has_any(words: Column, listed: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*(F.lit(w) for w in listed))) if listed else F.lit(False)


def categories(text: Column, rules: tuple = CONVERSATION_RULES, most: int = 0, otherwise: str = "statement") -> Column:
    """The names of all rules (words, phrases) that a text meets, in their order, at most ``most``; a question mark makes a question."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = tokens(text)
    hits = []
    for name, listed, phrases in rules:
        rule = has_any(words, listed)
        for p in phrases:
            rule = rule | F.contains(low, F.lit(p))
        if name == "question":
            rule = rule | F.contains(low, F.lit("?"))
        hits.append(F.when(rule, F.lit(name)))
    found = F.array_compact(F.array(*hits))
    found = F.when(F.size(found) == 0, F.array(F.lit(otherwise))).otherwise(found)
    return F.slice(found, 1, most) if most else found


def assigned(words: Column, taxonomy: dict[str, tuple[str, ...]], most: int, otherwise: str = "other") -> Column:
    """``name, hits`` of the categories of a taxonomy (words by category) by how many of a text's words are listed, best first, ties in the taxonomy's order."""
    at = {name: k for k, name in enumerate(taxonomy)}
    scored = [F.struct((-hits(words, listed)).alias("s"), F.lit(at[name]).alias("k"), F.lit(name).alias("name")) for name, listed in taxonomy.items()]
    best = F.slice(F.array_sort(F.filter(F.array(*scored), lambda x: x["s"] < 0)), 1, most)
    found = F.transform(best, lambda x: F.struct(x["name"].alias("name"), (-x["s"]).alias("hits")))
    none = F.array(F.struct(F.lit(otherwise).alias("name"), F.lit(0).alias("hits")))
    return F.get(F.transform(F.array(found), lambda f: F.when(F.size(f) == 0, none).otherwise(f)), F.lit(0))  # hits are counted once


def buckets(rows: DataFrame, top: int) -> DataFrame:
    """``category, items, terms``: how many items (``id, category, words``) each category has, and its most frequent words, ties by word."""
    # an item counts as a cell of its own beside its words, so that rows are read once
    cell = lambda item, term: F.struct(F.lit(item).alias("item"), term.alias("term"))
    words = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda t: cell(False, t))
    cells = rows.select("category", F.explode(F.concat(F.array(cell(True, F.lit(None).cast("string"))), words)).alias("x")).groupBy("category", "x.item", "x.term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("category", "item").orderBy(F.desc("n"), "term")
    best = cells.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    terms = F.array_sort(F.collect_list(F.when(~F.col("item"), F.struct("k", "term"))))
    return best.groupBy("category").agg(F.max(F.when(F.col("item"), F.col("n"))).alias("items"), F.transform(terms, lambda x: x["term"]).alias("terms"))


def relationship(left: str, right: str, similar: Column, least_negation: float = 0.3) -> Column:
    """``kind, shifts`` of two struct columns ``tone, stance, intent, negation``: similar ones with shifts contrast, without reinforce each other; others are adjacent."""
    x, y = (lambda f, s=s: F.col(f"{s}.{f}") for s in (left, right))
    moved = lambda f, none: F.when((x(f) != y(f)) & (x(f) != none) & (y(f) != none), F.concat(F.lit(f + ":"), x(f), F.lit("->"), y(f)))
    intent = F.when(x("intent") != y("intent"), F.concat(F.lit("intent:"), x("intent"), F.lit("->"), y("intent")))
    negation = F.when(F.abs(x("negation") - y("negation")) >= least_negation, F.lit("negation-shift"))
    shifts = F.array_compact(F.array(moved("tone", "neutral"), moved("stance", "unknown"), intent, negation))
    return F.struct(F.when(similar & (F.size(shifts) > 0), "contrast").when(similar, "reinforcing").otherwise("adjacent").alias("kind"), shifts.alias("shifts"))


def word_levels(text: Column, emphasis: tuple[str, ...], upper: float = 2.0, listed: float = 1.5, repeated: float = 1.0) -> Column:
    """``place, word, db`` of the words that are louder: in capitals (three letters at least), of a list, or with one letter three times running; the boosts add up."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9']+)"), F.lit(1))

    def level(w: Column, i: Column) -> Column:
        db = F.when((F.length(w) > 2) & (F.upper(w) == w) & (F.lower(w) != w), upper).otherwise(0.0)
        db = db + F.when(F.lower(w).isin(*emphasis), listed).otherwise(0.0) + F.when(F.lower(w).rlike(r"([a-z])\1\1"), repeated).otherwise(0.0)
        return F.struct((i + 1).alias("place"), w.alias("word"), db.alias("db"))

    return F.filter(F.transform(words, level), lambda x: x["db"] > 0)


def decibel_plan(text: Column, fillers: tuple[str, ...], base: float = 60.0, gain: float = 8.0, cut: float = 6.0) -> Column:
    """``target_db, gain_db``: 2 for five words at most, 1 for a mean of seven letters, 1.5 for a fifth in capitals, 1 for ``!`` or ``?``, -2 for a tenth of fillers; clamped."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9']+)"), F.lit(1))
    n = F.size(words)
    share = lambda f: F.size(F.filter(words, f)) / F.greatest(n, F.lit(1))
    mean = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / F.greatest(n, F.lit(1))
    db = F.when((n > 0) & (n <= 5), 2.0).otherwise(0.0) + F.when(mean >= 7, 1.0).otherwise(0.0)
    db = db + F.when(share(lambda w: (F.upper(w) == w) & (F.lower(w) != w)) >= 0.2, 1.5).otherwise(0.0) + F.when(F.coalesce(text, F.lit("")).rlike("[!?]"), 1.0).otherwise(0.0)
    db = db - F.when(share(lambda w: F.lower(w).isin(*fillers)) >= 0.1, 2.0).otherwise(0.0)
    held = F.greatest(F.lit(-cut), F.least(F.lit(gain), db))
    return F.struct((base + held).alias("target_db"), held.alias("gain_db"))


def own_segments(rows: DataFrame, by: list[str], order: str, names: list[str]) -> DataFrame:
    """Segments of a speaker (``speaker`` on the list, without case): those, else all of a group where no speaker is named, else those without one; ``place`` anew."""
    scope = Window.partitionBy(*by)
    mine = F.coalesce(F.lower(F.trim("speaker")).isin([n.lower() for n in names]), F.lit(False))
    some, named = F.max(F.when(mine, 1).otherwise(0)).over(scope), F.max(F.when(F.col("speaker").isNotNull(), 1).otherwise(0)).over(scope)
    kept = rows.withColumns({"_mine": mine, "_some": some, "_named": named})
    kept = kept.where(F.when(F.col("_some") == 1, F.col("_mine")).when(F.col("_named") == 0, True).otherwise(F.col("speaker").isNull()))
    return kept.drop("_mine", "_some", "_named").withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def connection(df: DataFrame, by: list[str], order: str, starters: tuple[str, ...], endings: tuple[str, ...]) -> DataFrame:
    """``connection`` of each segment (``speaker, text``) to the one before, 0 to 1: by that one's end mark and last word, this one's first word and letter, and the speakers."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumns({"_text": F.lag("text").over(w), "_speaker": F.lag("speaker").over(w), "_n": F.row_number().over(w)}).where("_n > 1")
    end = F.substring(F.rtrim("_text"), -1, 1)
    last, first = F.element_at(F.concat(F.array(F.lit("")), tokens("_text")), -1), F.coalesce(F.get(tokens("text"), F.lit(0)), F.lit(""))
    score = F.when(end.isin(".", "?", "!"), -0.2).when(end.isin(",", ";", ":"), 0.25).otherwise(0.35)
    score = score + F.when(last.isin(*endings), 0.25).otherwise(0.0) + F.when(first.isin(*starters), 0.2).otherwise(0.0)
    score = score + F.when(F.col("text").rlike("^[a-z]"), 0.1).otherwise(0.0) + F.when(F.col("_speaker") == F.col("speaker"), 0.2).otherwise(-0.1)
    return out.withColumn("connection", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)).drop("_text", "_speaker", "_n")


def focus_shifts(df: DataFrame, by: list[str], order: str, focus: str) -> DataFrame:
    """``before, after`` of neighbours whose focus differs."""
    out = df.withColumn("before", F.lag(focus).over(Window.partitionBy(*by).orderBy(order)))
    return out.where(F.col("before") != F.col(focus)).withColumnRenamed(focus, "after")


def pair_links(pairs: DataFrame, top: int) -> DataFrame:
    """``term, total, links``: for each term of counted pairs (``left, right, n``) the sum of its counts and its ``top`` partners, ties by name."""
    each = pairs.where("left <> right").select(F.col("left").alias("term"), F.col("right").alias("other"), "n").unionAll(pairs.where("left <> right").select("right", "left", "n"))
    ranked = each.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "other")))
    best = ranked.where(F.col("k") <= top).groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "other"))), lambda x: x["other"]).alias("links"))
    return each.groupBy("term").agg(F.sum("n").alias("total")).join(best, "term")


def symbol_rules(relations: DataFrame, least: int, evidence: int) -> DataFrame:
    """``type, symbol, related, n, evidence``: relations (``id, type, symbol, related``) seen in at least so many items, with the first of these."""
    ranked = relations.distinct().withColumn("_k", F.row_number().over(Window.partitionBy("type", "symbol", "related").orderBy("id")))
    first = F.array_sort(F.collect_list(F.when(F.col("_k") <= evidence, F.col("id"))))
    return ranked.groupBy("type", "symbol", "related").agg(F.count("*").alias("n"), first.alias("evidence")).where(F.col("n") >= least)


def usage(words: DataFrame, lists: DataFrame, total: str = "words") -> DataFrame:
    """``id, tag, hits, coverage``: how much of each item's words (``id, term, n``) each tagged list (``tag, term``) covers."""
    size = words.groupBy("id").agg(F.sum("n").alias(total))
    hits = words.join(lists.distinct(), "term").groupBy("id", "tag").agg(F.sum("n").alias("hits"))
    return hits.join(size, "id").withColumn("coverage", F.round(F.col("hits") / F.col(total), 6))


def recommended(found: DataFrame, boosts: DataFrame, top: int) -> DataFrame:
    """``id, tag, score, rank``: tags by coverage and the boosts (``id, tag, boost``) that apply, ties by tag."""
    extra = boosts.groupBy("id", "tag").agg(F.sum("boost").alias("boost"))
    out = found.select("id", "tag", "coverage").join(extra, ["id", "tag"], "full_outer")
    out = out.select("id", "tag", F.round(F.coalesce("coverage", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0)), 6).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "tag"))).where(F.col("rank") <= top)


def wave_stats(wave: Column, rate: int) -> Column:
    """``rms, peak, crossings, centroid`` of samples, by a pandas UDF over Arrow batches; an empty wave has zeros."""
    import pandas as pd

    def stats(waves: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for w in waves:
            x = np.asarray([] if w is None else w, float)
            if not len(x):
                out.append((0.0, 0.0, 0.0, 0.0))
                continue
            size = np.abs(np.fft.rfft(x))
            at = np.fft.rfftfreq(len(x), 1 / rate)
            signs = x >= 0
            out.append((np.sqrt((x * x).mean()), np.abs(x).max(), (signs[1:] != signs[:-1]).sum() / max(1, len(x) - 1), (size * at).sum() / size.sum() if size.sum() else 0.0))
        return pd.DataFrame(out, columns=["rms", "peak", "crossings", "centroid"])

    stats.__annotations__ = {"waves": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(stats, "rms double, peak double, crossings double, centroid double")(wave)


def flux(levels: DataFrame, by: list[str], order: str) -> DataFrame:
    """``flux``: mean change of pitch, volume and rate (0 to 1 each) between neighbours; 0 for one segment."""
    w = Window.partitionBy(*by).orderBy(order)
    parts = [F.abs(F.col(c) - F.lag(c).over(w)) for c in ("pitch", "volume", "rate")]
    return levels.withColumn("_d", sum(parts[1:], parts[0]) / 3).groupBy(*by).agg(F.round(F.coalesce(F.avg("_d"), F.lit(0.0)), 6).alias("flux"))


def volume_band(db: Column, low: str, middle: str, high: str) -> Column:
    """``high`` for an attenuation of 4 dB at most, ``middle`` for 8 at most, else ``low``."""
    return F.when(db <= 4, high).when(db <= 8, middle).otherwise(low)


def profile_similarity(left: str, right: str, fields: list[str]) -> Column:
    """Mean ratio similarity of the numeric fields of two struct columns."""
    parts = [ratio(F.col(f"{left}.{f}").cast("double"), F.col(f"{right}.{f}").cast("double")) for f in fields]
    return sum(parts[1:], parts[0]) / len(parts)


def derivative(kind: str, x: Column, value: Column, alpha: float = 0.01) -> Column:
    """The slope of an activation at ``x``, whose value there is ``value``."""
    kinds = {"sigmoid": value * (1 - value), "tanh": 1 - value * value, "relu": F.when(x > 0, 1.0).otherwise(0.0), "leaky": F.when(x >= 0, 1.0).otherwise(alpha), "softplus": 1 / (1 + F.exp(-x)), "linear": F.lit(1.0)}
    return kinds[kind]


def gated(value: Column, slope: Column, least: float) -> Column:
    return F.when(slope >= least, value).otherwise(F.lit(0.0))


def scaled(value: Column, slope: Column, weight: float) -> Column:
    return value * (1 + weight * slope)


def form_scores(text: Column) -> Column:
    """Shares of lines that look like code, lists, tables, dialogue or headings, as a map of name to score."""
    rows = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    n = F.greatest(F.size(rows), F.lit(1))
    forms = {"code": r"[{};]\s*$|^\s*(def|class|import|return|if|for)\b.*[:(]", "list": r"^\s*([-*+]|[0-9]+[.)])\s+", "table": r"\|.*\|", "dialogue": r"^[A-Z][A-Za-z]{0,20}:\s", "heading": r"^#{1,6}\s"}
    share = lambda pattern: F.round(F.size(F.filter(rows, lambda r: r.rlike(pattern))) / n, 6)
    return F.create_map(*(x for k, p in forms.items() for x in (F.lit(k), share(p))))


def primary_form(scores: Column, least: float = 0.2) -> Column:
    """The form with the largest score, ``prose`` when none reaches ``least``; ties by name."""
    best = F.array_min(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    return F.when(-best["s"] >= least, best["k"]).otherwise("prose")


def label_scores(text: Column, labels: dict[str, tuple[str, ...]]) -> Column:
    """``label, score`` of all labels (words by label) that a text has, by their share of its sentences' words, best first, ties by label."""
    words = tokens(text)
    n = F.greatest(F.size(words), F.lit(1))
    parts = [F.struct((-F.round(hits(words, listed) / n, 6)).alias("s"), F.lit(k).alias("label")) for k, listed in labels.items()]
    return F.transform(F.array_sort(F.filter(F.array(*parts), lambda x: x["s"] < 0)), lambda x: F.struct(x["label"].alias("label"), (-x["s"]).alias("score")))


def marked_sentences(text: Column, pattern: str, most: int) -> Column:
    """The first ``most`` sentences that a pattern finds, without case."""
    return F.slice(F.filter(sentences(text), lambda s: F.lower(s).rlike(pattern)), 1, most)


def complex_numbers(text: Column) -> Column:
    """``raw, re, im, magnitude, phase`` of the numbers ``a+bi`` of a text, then of those of the form ``bi`` outside them; phase by ``atan2``, both to 6 digits."""
    text = F.coalesce(text, F.lit(""))
    full = r"([+-]?[0-9]+(?:\.[0-9]+)?\s*[+-]\s*[0-9]+(?:\.[0-9]+)?\s*[ij])(?![A-Za-z0-9])"
    alone = r"([+-]?[0-9]+(?:\.[0-9]+)?[ij])(?![A-Za-z0-9])"
    pure = lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", ""), "[ij]$", "")

    def value(raw: Column, both: bool) -> Column:
        v = pure(raw)
        im = F.regexp_extract(v, r"([+-]?[0-9.]+)$", 1).cast("double")
        re = F.regexp_extract(v, r"^([+-]?[0-9.]+)[+-]", 1).cast("double") if both else F.lit(0.0)
        return F.struct(raw.alias("raw"), re.alias("re"), im.alias("im"), F.round(F.sqrt(re * re + im * im), 6).alias("magnitude"), F.round(F.atan2(im, re), 6).alias("phase"))

    rest = F.regexp_replace(text, full, " ")
    found = F.transform(F.regexp_extract_all(text, F.lit(full), F.lit(1)), lambda r: value(r, True))
    return F.concat(found, F.transform(F.regexp_extract_all(rest, F.lit(alone), F.lit(1)), lambda r: value(r, False)))


def packed_floats(v: Column) -> Column:
    """A vector as little-endian 32-bit floats, by a pandas UDF."""
    import pandas as pd

    def pack(vectors: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([None if x is None else np.asarray(x, "<f4").tobytes() for x in vectors], dtype=object)

    pack.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    return F.pandas_udf(pack, "binary")(v)


def unpacked_floats(data: Column) -> Column:
    import pandas as pd

    def unpack(blobs: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([None if x is None else np.frombuffer(x, "<f4") for x in blobs], dtype=object)

    unpack.__annotations__ = {"blobs": pd.Series, "return": pd.Series}
    return F.pandas_udf(unpack, "array<float>")(data)
