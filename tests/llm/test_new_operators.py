"""Conversation tries and repair, and near-duplicate embeddings, against plain versions of their definitions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakeloom.llm import caps, common, html, repair, suffix, trie


@pytest.fixture(autouse=True, scope="module")
def path(spark):
    common.put_on_path(spark)


TURNS = "conv_id long, turn long, role string, text string, words string, digest int"


def plain_trie(rows):
    """Nodes of the trie of rebuilt conversations by one pass over all prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[: 2 * trie.DIGEST]
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, saved, leaves = defaultdict(set), {}, {}
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    out = set()
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        ends = ",".join(map(str, sorted(c for c in members[node] if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(members[node]), len(node), parent, len(members[node]), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def odd_conversations(seed, n=400):
    rng = random.Random(seed)
    texts = ["", None, "a b", "Yes.", "yes.", "no!", "long " * 2000 + "end", " \t\n", "été naïve?", "x\x0bz"]
    roles = ["user", "assistant", "system", None, "", "tool"]
    rows = []
    for _ in range(n):
        conv = rng.choice([None, -3, -20, 7, 20, 23, 40, *range(60, 100)])
        rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts), "extra", 5))
    return rows + rows[:20]


def test_trie_equals_plain_version_however_small_tasks_are(spark):
    base = [(c, t, "system" if t == 0 else "user", f"shared {t}" if t < 3 else f"own {c % 7} {t}", "x", 1) for c in range(100, 180) for t in range(3 + c % 5)]
    for rows in (odd_conversations(3), base, odd_conversations(4) + base):
        df = spark.createDataFrame(rows, TURNS)
        lists = trie.with_shared_openings(trie.turn_lists(df))
        for turns in (trie.TASK_TURNS, 5, 40):
            got = trie.prefix_trie(lists, task_turns=turns).collect()
            assert len(got) == len({(r.depth, r.conv_id) for r in got})
            assert {tuple(r) for r in got} == plain_trie(rows), turns


def test_trie_of_no_conversations(spark):
    assert trie.prefix_trie(trie.with_shared_openings(trie.turn_lists(spark.createDataFrame([], TURNS)))).count() == 0


def plain_edits(faults):
    """Least cost and string of edits by trying all ways from the end."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {(len(faults), q): ((0, "") if q in ("", "a") else None) for q in step}
    for i in range(len(faults), -1, -1):
        here = {q: [best[i, q]] if i == len(faults) and best[i, q] else [] for q in step}
        if i < len(faults):
            initial, fault = faults[i]
            add = lambda q, letter, cost, to, i=i, here=here: here[q].append((cost + best[i + 1, to][0], letter + best[i + 1, to][1]))
            for q in step:
                add(q, "D", 2, q)
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    if initial and initial in step[q]:
                        add(q, "K", more, initial)
                    for to in set(step[q]) - {"s"}:
                        add(q, "R", 1 + more, to)
        for _ in range(4):
            for q in step:
                for to in set(step[q]) - {"s"}:
                    if here[to]:
                        cost, letters = min(here[to])
                        here[q].append((cost + 5, "I" + letters))
        for q in step:
            best[i, q] = min(here[q])
    return best[0, ""]


def plain_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        live = []
        for c, turn, role, text, *_ in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            live += [((turn is not None, turn or 0), "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        live.sort()
        seen, faults = set(), []
        for _, role, text in live:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            faults.append((role[:1], fault))
            seen.add((role, text))
        cost, audit = plain_edits(faults)
        turns = sorted({t for (known, t), *_ in live if known})
        lines, before, i = [], "", 0
        for letter in audit:
            _, role, text = live[i] if letter != "I" else (None, "", "")
            i += letter != "I"
            if letter in "RI":
                role = "assistant" if before == "u" else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
                before = role[:1]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        count = lambda f, faults=faults: sum(x == f for _, x in faults)
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        out[conv] = (conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(5)
    for _ in range(4000):
        codes = bytes(rng.choice([0, 4, 8, 12, 0, 4, 8, rng.randrange(16)]) for _ in range(rng.randrange(9)))
        faults = [((*repair.INITIALS, "?")[c >> 2], repair.FAULTS[c & 3]) for c in codes]
        assert repair.cheapest_edits(codes) == plain_edits(faults), codes


def test_repair_equals_plain_version(spark):
    rows = odd_conversations(11, 700)
    rows += [(5000 + c, t, ("system" if t == 0 else "assistant" if t % 2 == 0 else "user"), f"Text {t}.", "x", 0) for c in range(40) for t in range(12)]
    got = {r.conv_id: tuple(r) for r in repair.repair(repair.damage(spark.createDataFrame(rows, TURNS))).collect()}
    assert got == plain_repair(rows)
    assert repair.repair(repair.damage(spark.createDataFrame([], TURNS))).count() == 0


def test_long_conversation_needs_no_text_in_memory():
    codes = bytes([4, 8] * 50_000 + [7, 1])
    cost, audit = repair.cheapest_edits(codes)
    assert cost == 4 and audit == "K" * 100_000 + "DD"


VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, n int"


def plain_links(rows, least=0.93):
    bad = lambda v: v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v)
    some = list({(i, y, tuple(np.float32(v).astype(float))) for i, v, y, *_ in rows if i is not None and y is not None and not bad(v)})
    links, root = defaultdict(int), {}
    name = {r: r[0] for r in some}
    pairs = []
    for a in range(len(some)):
        for b in range(a + 1, len(some)):
            (_, y, u), (_, z, w) = some[a], some[b]
            if y == z and len(u) == len(w):
                if u == w or np.dot(u, w) / np.linalg.norm(u) / np.linalg.norm(w) >= least:
                    pairs.append((a, b))
    for a, b in pairs:
        links[some[a][0]] += 1
        links[some[b][0]] += 1
    parts = [r[0] for r in some]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(parts[a], parts[b])
            changed |= parts[a] != m or parts[b] != m
            parts[a] = parts[b] = m
    for r, m in zip(some, parts):
        root[r[0]] = min(root.get(r[0], m), m)
    del name
    return {(i, links[i], root.get(i, i), root.get(i, i) == i) for i, *_ in rows}


def family(rng, n, base, spread):
    x = base + spread * rng.standard_normal((n, len(base))) / np.sqrt(len(base))
    return (x * rng.uniform(0.1, 30, (n, 1))).astype(np.float32)


def test_links_of_families_odd_rows_and_blocks(spark):
    rng = np.random.default_rng(8)
    vectors = [*family(rng, 300, rng.standard_normal(24) / 5, 0.2), *family(rng, 100, rng.standard_normal(24) / 5, 0.02), *rng.standard_normal((300, 24)).astype(np.float32)]
    rows = [(k, [float(x) for x in v], k % 2, 1, "x", 2) for k, v in enumerate(vectors)]
    some = rows[3][1]
    rows += [rows[3], (9000, some, 1, 1, "x", 2), (9001, some, None, 1, "x", 2), (9002, None, 1, 1, "x", 2), (9003, [], 1, 1, "x", 2), (9004, [0.0] * 24, 1, 1, "x", 2)]
    rows += [(9005, [float("nan")] * 24, 1, 1, "x", 2), (9006, [None] * 24, 1, 1, "x", 2), (9007, [float("inf")] * 24, 1, 1, "x", 2), (9008, [1.0, 2.0], 1, 1, "x", 2), (9009, [2.0, 4.0], 1, 1, "x", 2), (9010, [1e-30] * 24, 1, 1, "x", 2), (9011, [3e30] * 24, 1, 1, "x", 2)]
    want = plain_links(rows)
    df = spark.createDataFrame(rows, VECTORS)
    for task_rows in (caps.TASK_ROWS, 40):
        got = [tuple(r) for r in caps.near_embeddings(df, task_rows=task_rows).collect()]
        assert len(got) == len(rows)
        assert len(set(got) ^ want) <= 0.01 * len(want), task_rows  # filters may miss a pair near the threshold
    assert caps.near_embeddings(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("rows", [1_000, 50_000, 1_000_000])
def test_filters_find_pairs_at_the_threshold(rows):
    rng = np.random.default_rng(rows)
    x, z = rng.standard_normal((2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    codes = caps.draw_codes(64, rows)
    sets = []
    for v in (x, y):
        row, name = caps.decode_all(codes, v)
        sets.append([set(name[row == k].tolist()) for k in range(len(v))])
    assert np.mean([bool(a & b) for a, b in zip(*sets)]) > 0.985


def test_decoding_finds_all_filters_over_the_bound():
    code, x = caps.Code.draw(12, 500), np.random.default_rng(2).standard_normal((50, 12))
    row, name = code.decode(x)
    turned, at, scores = x @ code.rotation, 0, np.zeros((50, 1))
    for block in code.blocks:
        part = turned[:, at : at + block.shape[1]]
        at += block.shape[1]
        scores = (scores[:, :, None] + (part / np.linalg.norm(part, axis=1, keepdims=True) @ block.T)[:, None, :]).reshape(50, -1)
    want = {(i, f) for i in range(50) for f in range(scores.shape[1]) if scores[i, f] >= min(code.bound, scores[i].max()) - 1e-12}
    assert set(zip(row.tolist(), name.tolist())) == want


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '", "<!", "</", "<", "<a href='x\"", '<a "\'', "<!--", '<p class="'])
def test_broken_tags_take_time_in_proportion(piece):
    began = time.time()
    for end in ("", ">", "</p>"):
        html.Page(piece * (3_000_000 // len(piece)) + end)
    assert time.time() - began < 20
    assert [b[1] for b in html.Page(f"<p>one</p>{piece}<p>two</p>").blocks][:1] == ["one"]


def main_texts(spark, pages):
    rows = [(k, f"https://n.example/{k}", source) for k, source in enumerate(pages)]
    found = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


@pytest.mark.parametrize("pages", [1, 2, 9])
def test_adverts_and_comments_go_on_however_many_pages(spark, pages):
    """An advert on a third of the pages, comments on another third; other names of the page's own stay."""
    odd = {0: '<div class="ad">Buy now</div>', 1: '<div class="comments"><p>First!</p></div>', 2: '<p class="notice">We moved</p>'}
    page = "<html><body><article class=story><h1>Story {k}</h1><p>Text {k}</p>{odd}<p>End {k}</p></article></body></html>"
    got = main_texts(spark, [page.format(k=k, odd=odd[k % 3]) for k in range(pages)])
    assert got == [f"Story {k}\n\nText {k}\n\nEnd {k}" for k in range(pages)]


def test_articles_side_by_side(spark):
    page = '<html><body><div class="page"><article class="lead"><h1>Story {k}</h1><p>Lead {k}</p></article><article class="body"><p>Body {k} and its long text</p></article><article class="more"><a href=/>Other stories of the day</a></article></div></body></html>'
    for pages in (1, 4):
        assert main_texts(spark, [page.replace("{k}", str(k)) for k in range(pages)]) == [f"Story {k}\n\nLead {k}\n\nBody {k} and its long text" for k in range(pages)]


def test_names_around_the_whole_page_are_its_own():
    long = "words of the story " * 9
    for wrap in ("promo-page", "social", "comments-open"):
        page = html.Page(f'<body><div class="masthead"><h1>Site</h1></div><div class="{wrap}"><article><p>{long}</p><div class="ad">Buy</div></article></div></body>')
        assert page.main() == page.main(frozenset()) == [long.strip()]
        page = html.Page(f'<body><div class="{wrap}"><h1>Story</h1><p>{long}</p><div class="ad">Buy</div></div></body>')
        assert page.main() == page.main(frozenset()) == ["Story", long.strip()]
    page = html.Page(f'<body><div class="post"><h1>T</h1><p>{long}</p></div><div class="comments"><article>{long * 5}</article></div></body>')
    assert page.main() == page.main(frozenset()) == ["T", long.strip()]
    assert html.Page(f'<body><div class="ad">{long}</div></body>').main() == []


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "deep" + "</div>" * 100_000, "<div>" * 50_000 + "deep" + "</section>" * 50_000, "<span>" * 50_000 + "<p>deep" * 50_000, "<div class=ad><p>" * 50_000 + "deep", f"<div class='{'name ' * 2000}'>" * 300 + "deep"])
def test_deep_pages_take_time_and_memory_in_proportion(source):
    import tracemalloc

    began = time.time()
    page = html.Page(source)
    assert time.time() - began < 20
    assert page.blocks[0][1] == "deep"
    tracemalloc.start()
    html.Page(source)
    assert tracemalloc.get_traced_memory()[1] < 120_000_000
    tracemalloc.stop()


def repeated_words(texts, words):
    """Number of words, of words covered by a repeated run, and what is left, by comparing all runs."""
    split = [(t or "").split() for t in texts]
    count = Counter(tuple(w[a : a + words]) for w in split for a in range(len(w) - words + 1))
    out = []
    for w in split:
        covered = {k for a in range(len(w) - words + 1) if count[tuple(w[a : a + words])] > 1 for k in range(a, a + words)}
        out.append((len(w), len(covered), [x for k, x in enumerate(w) if k not in covered]))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeated_runs_of_words(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_SEGMENTS", hot)
    draw = random.Random(5)
    own = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    short = [f"{a}{b}" for a in "abcdefg" for b in "stuvwxyz"][:50]
    exact, less, wide = own(50), own(49), [w * 9 for w in own(70)]
    texts = [None, "", " \n ", "few words", " ".join(less), " ".join(less + own(3)), " ".join(exact), "x " + "\n\t".join(exact) + "  y z"]
    texts += [" ".join(own(k) + short + own(9)) for k in (0, 7, 200)] + [" ".join(own(30) + wide[:60] + own(5)), " ".join(wide), "na " * 60, "na " * 30 + "é日本 " * 90, "same text of its own " * 4]
    texts += [" ".join(draw.choice("ab") for _ in range(300)), " ".join(own(20) + wide[5:58] + short[:49] + own(10))]
    texts += [" ".join(own(2) + exact[:25] + own(1) + exact[26:] + own(40)) for _ in range(3)]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(3, "few words", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = suffix.remove_repeated_words(df.withColumnRenamed("n_words", "row"), keep=("row",), scope="words").collect()
    assert len(got) == len(rows)
    want = repeated_words(texts, 50)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_text.split()) == want[r.doc_id] and r.row == r.doc_id
        assert r.n_removed or r.kept_text == (texts[r.doc_id] or "")
    assert {r.doc_id for r in got if r.n_removed} >= {6, 7, 8, 9, 10, 11, 12, 13} and not {r.doc_id for r in got if r.n_removed} & {0, 1, 2, 3, 4, 5}
    assert suffix.remove_repeated_words(df.limit(0), scope="words").count() == 0
    common.release(spark, "words")


def test_word_codes():
    texts = ["", " ", "a", "a b", "\n b\ta\x0b\x0ca\r b ", "x" * 64, "x" * 65 + " " + "x" * 66 + " " + "x" * 65, "é\u00a0日本 a"]
    code = {}
    for t, codes in zip(texts, suffix.codes_of([t.encode() for t in texts]), strict=True):
        found = np.frombuffer(codes, "<u4").tolist()
        assert len(found) == len(t.encode().split())
        assert all(code.setdefault(w, c) == c for w, c in zip(t.encode().split(), found, strict=True))
    assert len(set(code.values())) == len(code) and suffix.codes_of([]) == []
    alone = [suffix.codes_of([t.encode()])[0] for t in texts]
    assert alone == suffix.codes_of([t.encode() for t in texts])


def test_suffix_query_counts_passages_under_400_bytes(spark, tmp_path):
    """Passages of 50 words or more that no 400-byte string holds: the contract's columns leave them, the words of passages count them."""
    draw = random.Random(41)
    own = lambda n: [f"{draw.randrange(10**5)}" for _ in range(n)]
    passages = [own(k) for k in (50, 51, 55, 60, 49)]
    texts = [" ".join(own(draw.randint(0, 90)) + passages[k % 5] + own(draw.randint(1, 90))) for k in range(25)]
    texts += [" ".join(own(draw.randint(1, 200))) for _ in range(15)] + [None, "", "one " * 55, " \n".join(passages[1])]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    got = {r.doc_id: r for r in suffix.op7_suffix_dedup(spark, f"{tmp_path}/in").collect()}
    want = repeated_words(texts, 50)
    assert {k: r.n_passage_words for k, r in got.items()} == {k: n for k, (_, n, _) in enumerate(want)}
    assert all((r.n_passages > 0) == (r.n_passage_words > 0) and r.n_removed == 0 and r.text == (texts[k] or "") for k, r in got.items())
    assert {k for k in range(40) if got[k].n_passages} == {k for k in range(25) if k % 5 < 4} and got[42].n_passages == got[43].n_passages == 1
