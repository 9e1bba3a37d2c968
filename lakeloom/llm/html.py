"""Main text of web pages by equivalence-class template deduction.

Pages of a host share a template. Its tokens, tags in their place, occur equally often in each page;
tokens that share the vector of their occurrences form a class, and valid classes nest into the
template. An element whose tags belong to a class is a slot; slots nest as their elements do. The
main slot is found by going down from the widest one as long as one inner slot holds most of the text
of all pages that is no link. The text that fills it is the main text, but for slots of menus, forms,
comments and the like: those are known by HTML's own elements and roles, and by class names. Names of
adverts, notices, menus, forms, side and foot parts and comments count on every page, however many pages of
the host have them; names that may as well be a paragraph's subject (``TOPICS``) only where the template has them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Pages with different texts that a host must have before its template is deduced.
LEAST_PAGES = 2
#: Share of a host's pages that a class must cover.
LEAST_SHARE = 0.5
#: Tags that a valid class must have.
LEAST_TAGS = 2
#: Share of a slot's text that an inner slot must hold to be taken for it.
MOST_TEXT = 0.6
#: Share of a part's text in links from which on it is a menu.
LINKS = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag of the key ends when they are open.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th tr tbody ul ol dl".split())
NOT_TEXT = frozenset("head nav footer aside form script style noscript template button select option textarea iframe object svg math canvas audio video menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORD = r"ads?|advert\w*|adsense|sponsor(?:ed|s)?|promo(?:tion|tions|s)?|banner|sidebar|comments?|commentlist|respond|replies|disqus|notices?|cookies?|consent|gdpr|newsletter|subscri\w*|signup|login|signin|breadcrumbs?|menu|nav|navbar|navigation|footer|masthead|popup|modal|paywall|toolbar|pagination|pager|disclaimer|alert"
_TOPIC = r"share|sharing|social|related|recommend\w*|widgets?|skip"
UNWANTED = re.compile(rf"(?:^|[\s_-])(?:{_WORD})(?=$|[\s_-])", re.I)
TOPICS = re.compile(rf"(?:^|[\s_-])(?:{_TOPIC})(?=$|[\s_-])", re.I)
#: Elements nested deeper than browsers keep apart share the place of the last one above; their text stays.
DEEPEST = 512
#: Longer class lists stand in a place as their digest.
LONGEST_NAME = 64
HIDDEN = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: A tag holds no ``<`` outside of quotes, so a broken one ends where the next begins and no text is scanned twice for its end.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^<>]*>", re.S)
ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Node:
    """An open element: its place, the token of its end, its depth, the name of the nearest block, whether HTML's own elements make its text unwanted, the places around it whose names may, and the article or main part it lies in."""

    __slots__ = ("name", "path", "shut", "depth", "block", "bad", "named", "root")

    def __init__(self, name: str, path: str, shut: str, depth: int, block: str, bad: bool, named: tuple[str, ...], root: str):
        self.name, self.path, self.shut, self.depth, self.block = name, path, shut, depth, block
        self.bad, self.named, self.root = bad, named, root


class Page:
    """Blocks of text and tag tokens of a page.

    ``blocks``: path, text, article or main part around it, unwanted, named places, characters in links, position.
    ``strong``: named places whose name counts on every page. ``heads``, ``parts``: the named places around first
    headings and around article and main parts.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, str, bool, tuple[str, ...], int, int]] = []
        self.tags: list[tuple[str, int]] = []
        self.stack = [Node("", "", "/", 0, "", False, (), "")]
        self.known: dict[str, str] = {}
        self.opened: dict[str, int] = {}
        self.strong: set[str] = set()
        self.heads: dict[tuple[str, ...], None] = {}
        self.parts: dict[tuple[str, ...], None] = {}
        self.text: list[str] = []
        self.linked: list[str] = []
        self.links = 0
        self.at = 0
        end = 0
        pos = 0
        while True:
            m = TOKEN.search(source, pos)
            if m is None:
                break
            if m.start() > end:
                self.add(source[end : m.start()])
            pos = end = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self.close(name)
            else:
                self.open(name, m[3] or "")
                if name in RAW:
                    stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, end)
                    pos = end = stop.start() if stop else len(source)
        if end < len(source):
            cut = re.compile(r"<[a-zA-Z/!]").search(source, max(end, source.rfind(">") + 1))  # a tag that the page breaks off in
            self.add(source[end : cut.start()] if cut else source[end:])
        self.flush()

    def add(self, text: str) -> None:
        self.text.append(text)
        if self.links:
            self.linked.append(text)

    def flush(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split()) if any(not t.isspace() for t in self.text) else ""
            links = len(" ".join("".join(self.linked).split())) if self.linked else 0
            self.text, self.linked = [], []
            if text:
                top = self.stack[-1]
                self.blocks.append((top.path, text, top.root, top.bad, top.named, min(links, len(text)), self.at))
                self.at += 1

    def place(self, path: str) -> str:
        """The path as one string, however many elements have it."""
        return self.known.setdefault(path, path)

    def tag(self, path: str) -> None:
        self.tags.append((path, self.at))
        self.at += 1

    def pop(self, keep: int) -> None:
        for node in self.stack[keep:]:
            self.opened[node.name] -= 1
            self.links -= node.name == "a"
        del self.stack[keep:]

    def open(self, name: str, attrs: str) -> None:
        if name in BLOCK:
            self.flush()
            ends = ENDS.get(name, {"p"} if name not in ("option",) else set())
            while self.stack[-1].name in ends or (self.inline() and self.stack[-1].block in ends):
                self.pop(len(self.stack) - 1)
        elif name == "br":
            self.text.append(" ")
        if name in VOID:
            if name != "br":
                self.tag(self.place(f"{self.stack[-1].path}/{name}"))
            return
        up = self.stack[-1]
        marks = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)} if attrs else {}
        label = " ".join(x for x in (marks.get("class", ""), marks.get("id", "")) if x)
        if up.depth < DEEPEST:
            names = ".".join(marks.get("class", "").replace("/", " ").split())
            path = self.place(f"{up.path}/{name}" + (f".{names}" if names and len(names) <= LONGEST_NAME else f".{hash64(names):x}" if names else ""))
            shut = self.place(path + "/")
        else:
            path, shut = up.path, up.shut
        part = name in ("article", "main") or marks.get("role") == "main"
        if name in ("html", "body", "main"):
            bad = up.bad
        else:
            # an article inside another one is a reader's comment
            bad = up.bad or name in NOT_TEXT or marks.get("role", "").lower() in ROLES or (name == "header" and not up.root) or (name == "article" and self.in_article())
            bad = bad or bool(attrs and HIDDEN.search(re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "=", attrs) if "hidden" in attrs and "aria-hidden" not in attrs else attrs))
        named = up.named
        if label and name not in ("html", "body"):
            strong = bool(UNWANTED.search(label))
            if (strong or TOPICS.search(label)) and path not in named[-1:]:
                named = (*named, path)
            if strong:
                self.strong.add(path)
        root = up.root or (path if part else "")
        if not bad and name == "h1":
            self.heads.setdefault(named)
        if not bad and part:
            self.parts.setdefault(named)
        self.stack.append(Node(name, path, shut, up.depth + 1, name if name in BLOCK else up.block, bad, named, root))
        self.opened[name] = self.opened.get(name, 0) + 1
        self.links += name == "a"
        self.tag(path)

    def in_article(self) -> bool:
        return self.opened.get("article", 0) > 0

    def inline(self) -> bool:
        return self.stack[-1].name not in BLOCK and len(self.stack) > 1

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        elif name == "br":
            self.text.append(" ")
            return
        if not self.opened.get(name):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == name:
                self.tag(self.stack[k].shut)
                self.pop(k)
                return
            if name not in BLOCK and self.stack[k].name in BLOCK:
                return  # an inline end tag does not reach over a block

    def wanted(self, named: frozenset[int] | None) -> list[tuple]:
        """Blocks that no element of HTML and no name makes unwanted.

        Weak names count if the template has their place (``None``: always). Names that would take away all first headings,
        all article and main parts and most of the text are the page's own: those around its first part (or heading) do not count.
        """
        counts = lambda p: named is None or p in self.strong or hash64(p) in named
        hit = {c: any(map(counts, c)) for c in {*self.heads, *self.parts, *(b[4] for b in self.blocks)}}
        blocks = [b for b in self.blocks if not b[3]]
        left = [b for b in blocks if not hit[b[4]]]
        if (self.heads or self.parts) and all(map(hit.get, self.heads)) and all(map(hit.get, self.parts)):
            own = next(iter(self.parts or self.heads))
            more = [b for b in blocks if not any(counts(p) for p in b[4] if p not in own)]
            if sum(len(b[1]) for b in more) > 2 * sum(len(b[1]) for b in left):
                return more
        return left

    def main(self, named: frozenset[int] | None = None, main_path: str | None = None) -> list[str]:
        """Texts of the main slot, and of article and main parts beside it that are no lists of links; a page that does not have it is judged by itself."""
        wanted = self.wanted(named)
        if main_path is None or not any(inside(b[0], main_path) for b in wanted):
            main_path = main_slot(masses(wanted), {b[2] for b in wanted if b[2]})
        beside: dict[str, list[int]] = {}
        for b in wanted:
            if b[2] and b[2].rpartition("/")[0] == main_path.rpartition("/")[0]:
                row = beside.setdefault(b[2], [0, 0])
                row[0] += len(b[1])
                row[1] += b[5]
        paths = [main_path] + ([p for p, (chars, links) in beside.items() if links < LINKS * chars] if main_path in beside else [])
        return [b[1] for b in wanted if any(inside(b[0], p) for p in paths)]


def inside(path: str, container: str) -> bool:
    return path == container or path.startswith(container + "/")


def masses(blocks: list[tuple]) -> dict[str, list[int]]:
    """Of each place around wanted blocks: characters, those in links, and whether it holds a first heading."""
    out: dict[str, list[int]] = {}
    for path, text, _, _, _, links, _ in blocks:
        head = path.rpartition("/")[2].split(".")[0] == "h1"
        at = path
        if at.rpartition("/")[2].split(".")[0] in LEAF:
            at = at.rpartition("/")[0]
        while True:
            row = out.setdefault(at, [0, 0, 0])
            row[0] += len(text)
            row[1] += links
            row[2] |= head
            if not at:
                break
            at = at.rpartition("/")[0]
    return out


def main_slot(mass: dict[str, list[int]], parts: set[str]) -> str:
    """The slot (a place with characters, those in links, and headings) that holds the main text.

    An article or main part with text is taken as it is, the one with most text. Else the way leads from the
    widest slot to the inner one that holds ``MOST_TEXT`` of its text without links, and back to the
    nearest one around it that holds a first heading, if that is not the whole body.
    """
    plain = lambda p: mass[p][0] - mass[p][1]
    marked = [p for p in parts if p in mass and mass[p][0]]
    if marked:
        return max(marked, key=lambda p: (plain(p), -len(p), p))
    inner: dict[str, list[str]] = {}
    for p in mass:
        if p:
            around = p.rpartition("/")[0]
            while around and around not in mass:
                around = around.rpartition("/")[0]
            inner.setdefault(around, []).append(p)
    at = ""
    while inner.get(at):
        best = max(inner[at], key=lambda p: (plain(p), p))
        if plain(best) < MOST_TEXT * plain(at) or not plain(best):
            break
        at = best
    around = at
    while around and not mass[around][2]:
        around = around.rpartition("/")[0]
        while around and around not in mass:
            around = around.rpartition("/")[0]
    return around if around and around.rpartition("/")[2].split(".")[0] not in ("html", "body") else at


def host_of(url) -> F.Column:
    """Host of a URL in lower case; empty for null and for URLs without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def occurrences(pages: DataFrame) -> DataFrame:
    """Statistics of tokens by host, added up batch by batch before they are shuffled.

    ``host, kind, token long, label, pages, vector long, place double, chars, links, heads long``. Kinds: ``tag``,
    ``slot`` (places around wanted text), ``part`` (articles and main parts with text), ``named`` (places with a weak
    class name), ``page`` (one row a different text), ``all`` (the host's pages). ``vector`` adds up a number drawn from page
    and count, so tokens with equal vectors of occurrences have equal ones.
    """
    names = ["host", "kind", "token", "label", "pages", "vector", "place", "chars", "links", "heads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats: dict[tuple, list] = {}
            for host, key, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(source)
                tags: dict[str, list[int]] = {}
                for path, at in page.tags:
                    tags.setdefault(path, [0, at])[0] += 1
                rows = [("tag", hash64(path), path, at, count, (0, 0, 0)) for path, (count, at) in tags.items()]
                wanted = page.wanted(frozenset())
                rows += [("slot", hash64(path), path, 0, 1, tuple(m)) for path, m in masses(wanted).items()]
                rows += [("part", hash64(path), path, 0, 1, (0, 0, 0)) for path in {b[2] for b in wanted if b[2]}]
                rows += [("named", hash64(path), path, 0, 1, (0, 0, 0)) for path in {p for b in page.blocks for p in b[4]} - page.strong]
                rows.append(("page", hash64("\n\n".join(b[1] for b in page.blocks)), "", 0, 1, (0, 0, 0)))
                rows.append(("all", 0, "", 0, 1, (0, 0, 0)))
                for kind, token, label, place, count, mass in rows:
                    r = stats.setdefault((host, kind, token, label), [0, 0, 0.0, 0, 0, 0])
                    r[0] += 1
                    r[1] += xxhash.xxh3_64_intdigest(b"%d %d" % (key, count)) >> 32
                    r[2] += place
                    for k in range(3):
                        r[3 + k] += mass[k]
            if stats:
                columns = [*zip(*stats, strict=True), *zip(*stats.values(), strict=True)]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("key"), F.coalesce("html", F.lit("")).alias("html"))
    schema = "host string, kind string, token long, label string, pages long, vector long, place double, chars long, links long, heads long"
    found = rows.mapInArrow(run, schema)
    total = lambda c: F.sum(c).alias(c)
    return found.groupBy("host", "kind", "token", "label").agg(*(total(c) for c in names[4:]))


def templates(pages: DataFrame, scope: str = "lakeloom", tokens: DataFrame | None = None) -> DataFrame:
    """One row a host with at least ``LEAST_PAGES`` different pages: its template.

    ``host, pages long, main_path string`` (the main slot), ``named array<long>`` (places of the template with
    a weak class name), ``classes array<struct<id:int,parent:int,
    pages:long,tags:array<string>>>``: the valid classes, each with the class it nests in (-1: none) and its
    tags in page order.
    """
    tokens = materialize(occurrences(pages), scope) if tokens is None else tokens
    hosts = tokens.groupBy("host").agg(F.sum(F.when(F.col("kind") == "all", F.col("pages"))).alias("of"), F.count(F.when(F.col("kind") == "page", 1)).alias("different"))
    hosts = materialize(hosts.where(F.col("different") >= LEAST_PAGES), scope)
    # at most a few tokens more than a page has pass: each must be in half of the host's pages
    frequent = tokens.where("kind in ('tag', 'slot', 'part', 'named')").join(hosts, "host").where(F.col("pages") >= LEAST_SHARE * F.col("of"))
    frequent = frequent.select("host", "of", "kind", "token", "label", "pages", "vector", (F.col("place") / F.col("pages")).alias("place"), "chars", "links", "heads")

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        classes: dict[int, list[dict]] = {}
        for r in rows:
            if r["kind"] == "tag":
                classes.setdefault(r["vector"], []).append(r)
        valid = []
        for members in classes.values():
            members.sort(key=lambda r: (r["place"], r["token"]))
            if len(members) >= LEAST_TAGS:
                valid.append(members)
        # wider classes first, so that a class nests in the narrowest one around it
        valid.sort(key=lambda c: (c[0]["place"] - c[-1]["place"], c[0]["token"]))
        out = []
        for k, members in enumerate(valid):
            around = [j for j in range(k) if valid[j][0]["place"] <= members[0]["place"] and members[-1]["place"] <= valid[j][-1]["place"]]
            out.append({"id": k, "parent": around[-1] if around else -1, "pages": members[0]["pages"], "tags": [r["label"] for r in members]})
        # slots are elements whose tags belong to a class of the template
        known = {tag.rstrip("/") for c in out for tag in c["tags"]} | {""}
        named = {r["token"] for r in rows if r["kind"] == "named" and r["label"] in known}
        slots = {r["label"]: [r["chars"], r["links"], r["heads"]] for r in rows if r["kind"] == "slot" and r["label"] in known}
        low = {r["label"] for r in rows if r["token"] in named}
        slots = {p: m for p, m in slots.items() if not any(inside(p, n) for n in low)}
        if "" in slots:
            slots[""] = [sum(m[k] for p, m in slots.items() if p and "/" not in p[1:]) or slots[""][k] for k in range(2)] + [slots[""][2]]
        parts = {r["label"] for r in rows if r["kind"] == "part" and r["label"] in slots}
        found = main_slot(slots, parts) if slots else None
        kind = pa.list_(pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("pages", pa.int64()), ("tags", pa.list_(pa.string()))]))
        columns = {"host": pa.array([rows[0]["host"]], pa.string()), "pages": pa.array([rows[0]["of"]], pa.int64()), "main_path": pa.array([found or None], pa.string())}
        return pa.table(columns | {"named": pa.array([sorted(named)], pa.list_(pa.int64())), "classes": pa.array([out], kind)})

    schema = "host string, pages long, main_path string, named array<long>, classes array<struct<id:int,parent:int,pages:long,tags:array<string>>>"
    return frequent.groupBy("host").applyInArrow(run, schema)


def extract_text(pages: DataFrame, scope: str = "lakeloom") -> DataFrame:
    """``page_id, url, text, n_chars long``: the main text of every page, a row a row of the input.

    The whole html is read. Blocks (character references decoded, runs of white space one space,
    trimmed) are joined in page order by two line feeds; text inside the main slot stays, however often
    other pages repeat it. Null and empty html, and pages without main text, give an empty text; pages with a null
    url form a host of their own; tags that are never closed and pages that break off are read as far as
    they go; repeated rows are kept; other columns are ignored. A page without others of its host is
    judged by itself.
    """
    tokens = materialize(occurrences(pages), scope)
    found = materialize(templates(pages, scope, tokens).select("host", "named", "main_path"), scope)
    discard(tokens)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    # the templates have a known size by now: Spark broadcasts them while they are small and shuffles beyond
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "host", "named", "main_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, frozenset | None] | None = None
        for batch in batches:
            out = []
            for source, host, named, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist(), strict=True):
                if held is None or held[0] != host:
                    held = host, frozenset(named.as_py()) if named.is_valid else None
                out.append("\n\n".join(Page(source).main(held[1], path)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op3_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .common import table

    return extract_text(table(spark, sf_dir, "pages"))
