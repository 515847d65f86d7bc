"""Main text of web pages by site style trees.

The element trees of a host's pages are merged: an element's place is its path from the root, told by the sequence of
children (tag and class) at every step, so that elements of different pages share a place if all above them looks alike.
Over the pages that have a place, its importance is

* for elements with children the entropy of the styles (sequences of children) met there: the more the pages differ in
  presentation, the more it matters; always the same layout has importance 0,
* for text 1 less the mean entropy of each content over the pages: a text that stands on all pages has importance 0,
  texts that differ from page to page have importance 1,

both in logarithms to the number of pages, and 1 for a place that a single page has.  Within a page, importance is passed
upwards from children to parents, and branches are cut in which no element reaches the threshold.  The tree of a host
never is in one place: places and what was met there are rows, counted with partial sums before any exchange.

Markup that says what it is counts beside the tree, unless importance and share of text contradict it: menus, footers,
adverts, forms, comments and the like go, but on a page without article not the branch that holds nearly all of its text;
and an article (else a main element) is kept, but not if more important text stands outside of it.  Within articles the
branches below the threshold are cut too, if most pages of the host have their place (two versions of an article prove
nothing) and not where most of an article would go, as on hosts that repeat one.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.llm.url_filter import host
from questloom.session import stage

THRESHOLD = 0.2
#: How much of an element's importance its own style is, for each style met at its place.
FADE = 0.9
#: A branch named as noise stays if it holds more than this part of a page's text and the page has no article.
NEARLY_ALL = 0.75
#: Within articles, places that fewer pages have are not cut.
LEAST_PAGES = 3
#: Up to so many places below full importance they are sent to all tasks (24 bytes each); beyond, they are joined.
MOST_SENT = 1_000_000

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block of text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = {"br", "td", "th"}
#: Elements whose text is never part of an article.
NOISE_TAGS = set(
    "head script style noscript template nav footer aside form button select textarea input label iframe object svg canvas"
    " dialog menu".split()
)
#: Those of them that a page may wrap around its text.
SOFT_TAGS = set("nav footer aside form dialog menu".split())
#: Words in a class, id or role that say the same.
NOISE_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget ad ads adbox advert adverts advertisement"
    " advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe"
    " share sharing social related recommended comment comments commentlist respond reply replies disqus login signup search"
    " pagination pager toolbar complementary contentinfo".split()
)
#: As above, but only outside of articles, whose own header holds their title.
OUTER_TAGS, OUTER_WORDS = {"header"}, {"header", "masthead"}
#: Parts of tables and lists, which are not cut out of an article's tables and lists.
PARTS = set("caption dd dt figcaption li summary tbody tfoot thead tr".split())
CLOSES_P = BLOCKS - {"body", "html"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Tree(HTMLParser):
    """The elements of a page in document order, and its events: (element, None) opens, (-1 - element, None) closes,
    (element, text) is text in it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.names, self.roles, self.parents = ["#"], [""], [frozenset()], [-1]
        self.children: list[list[int]] = [[]]
        self.texts: list[list[str]] = [[]]
        self.events: list[tuple[int, str | None]] = []
        self.open = [0]
        self.count = {}
        self.feed(html)
        self.close()
        while len(self.open) > 1:
            self._leave()

    def _leave(self) -> None:
        node = self.open.pop()
        self.count[self.tags[node]] -= 1
        self.events.append((-1 - node, None))

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and self.tags[self.open[-1]] != "p" and self.count.get("p"):
            # A block ends an open paragraph, and with it the inline elements left open there.
            inner = [self.tags[i] for i in self.open[len(self.open) - 1 - self._above("p") :]]
            if not any(t in CLOSES_P for t in inner[1:]):
                self._end("p")
        elif tag in CLOSES_P and self.tags[self.open[-1]] == "p":
            self._end("p")
        while self.tags[self.open[-1]] in CLOSED_BY.get(tag, ()):
            self._leave()
        given = dict(attrs)
        node = len(self.tags)
        parent = self.open[-1]
        self.tags.append(tag)
        self.names.append(f"{tag}.{given.get('class') or ''}")
        said = " ".join(str(given.get(k) or "") for k in ("class", "id", "role"))
        self.roles.append(frozenset(w.lower() for w in WORDS.findall(said)) if said.strip() else frozenset())
        self.parents.append(parent)
        self.children.append([])
        self.children[parent].append(node)
        self.texts.append([])
        self.events.append((node, None))
        if tag in VOID:
            self.events.append((-1 - node, None))
        else:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _above(self, tag: str) -> int:
        for up in range(len(self.open)):
            if self.tags[self.open[-1 - up]] == tag:
                return up
        return -1

    def _end(self, tag: str) -> None:
        while self.tags[self.open[-1]] != tag:
            self._leave()
        self._leave()

    def handle_endtag(self, tag):
        if self.count.get(tag):
            self._end(tag)

    def handle_data(self, data):
        node = self.open[-1]
        self.texts[node].append(data)
        self.events.append((node, data))

    def places(self, site: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each element: its place in the site's tree, its style there, and its content (0 if it has none)."""
        pack, digest = struct.Struct("<QQI").pack, xxhash.xxh3_64_intdigest
        place = [digest(site)] * len(self.tags)
        style, content = [0] * len(self.tags), [0] * len(self.tags)
        for node in range(len(self.tags)):
            below = self.children[node]
            if below:
                style[node] = digest("|".join([self.names[c] for c in below])) | 1
                for i, child in enumerate(below):
                    place[child] = digest(pack(place[node], style[node], i))
            text = " ".join("".join(self.texts[node]).split())
            if text:
                content[node] = digest(text) | 1
        return tuple(np.array(x, np.uint64).view(np.int64) for x in (place, style, content))

    def noise(self, node: int, in_article: bool) -> bool:
        tag, roles = self.tags[node], self.roles[node]
        if tag in ("html", "body"):
            return False
        if tag in NOISE_TAGS or roles & NOISE_WORDS:
            return True
        return not in_article and (tag in OUTER_TAGS or bool(roles & OUTER_WORDS))

    def articles(self, noisy: list[bool]) -> set[int]:
        """The articles that are no noise and in none; else any that are no noise."""
        return self._found(lambda n: self.tags[n] == "article", noisy)

    def mains(self, noisy: list[bool]) -> set[int]:
        return self._found(lambda n: self.tags[n] == "main" or "main" in self.roles[n], noisy)

    def _found(self, wanted, noisy: list[bool]) -> set[int]:
        candidates = [n for n in range(1, len(self.tags)) if wanted(n) and not noisy[n]]
        if not candidates:
            return set()
        quiet = self._below(noisy)
        return {n for n in candidates if not quiet[n]} or set(candidates)

    def _below(self, marked: list[bool]) -> list[bool]:
        """For each element whether one above it is marked."""
        below = [False]
        for node in range(1, len(self.tags)):
            up = self.parents[node]
            below.append(below[up] or marked[up])
        return below

    def weights(self, without: list[bool]) -> list[int]:
        """How many characters each branch holds outside of links and of the branches ``without``."""
        found = [len("".join(t).strip()) if t else 0 for t in self.texts]
        for node in range(len(found) - 1, 0, -1):
            if without[node] or self.tags[node] == "a":
                found[node] = 0
            else:
                found[self.parents[node]] += found[node]
        return found

    def chosen(self, cut: list[bool], noisy: list[bool]) -> tuple[set[int], set[int], set[int]]:
        """The articles, else main elements, whose text is wanted (none: the page's); the branches that stay though they
        are named as noise; and the articles that are mere lists of links, to leave out of a page's text."""
        n = len(self.tags)
        left_out = [a or b for a, b in zip(noisy, cut)]
        important = self.weights(left_out)
        articles = self.articles(noisy)
        cards: set[int] = set()
        if articles:
            outermost, hidden = self._outermost(articles), self._below(left_out)
            plain = self.weights(noisy)
            held = sum(plain[i] for i in outermost)
            outside = important[0] - sum(important[i] for i in outermost if not hidden[i])
            if outside <= held:
                return articles, set(), set()
            every = [len("".join(t).strip()) if t else 0 for t in self.texts]
            for node in range(n - 1, 0, -1):
                every[self.parents[node]] += every[node]
            cards = {i for i in outermost if 2 * plain[i] < every[i]}
        mains = self.mains(noisy)
        if mains:
            if not articles or 2 * sum(important[i] for i in self._outermost(mains)) > important[0]:
                return mains, set(), cards
        if articles:
            return set(), set(), cards
        never = [t in NOISE_TAGS and t not in SOFT_TAGS for t in self.tags]
        whole = self.weights([a or b for a, b in zip(never, cut)])
        spared = {i for i in range(1, n) if noisy[i] and not never[i] and not cut[i] and whole[i] > NEARLY_ALL * whole[0]}
        return set(), spared, set()

    def _outermost(self, chosen: set[int]) -> list[int]:
        inner = self._below([i in chosen for i in range(len(self.tags))])
        return [i for i in chosen if not inner[i]]

    def cuts(self, articles: set[int], cut: list[bool], noisy: list[bool], pages: np.ndarray) -> list[bool]:
        """The branches to cut: those in ``cut``; within articles only whole blocks whose place most pages of the host have,
        and only if most of the article stays."""
        if not articles or not any(cut):
            return cut
        n = len(self.tags)
        of = [0] * n
        for node in range(1, n):
            of[node] = of[self.parents[node]] or (node if node in articles else 0)
        own = [a and (not of[i] or self.noise(i, True)) for i, a in enumerate(noisy)]
        least = max(LEAST_PAGES, int(pages[0]) / 2)
        allowed = [
            cut[i] and of[i] > 0 and i not in articles and pages[i] >= least and self.tags[i] in BLOCKS and self.tags[i] not in PARTS
            for i in range(n)
        ]
        before, after = self.weights(own), self.weights([a or b for a, b in zip(own, allowed)])
        return [allowed[i] and 2 * after[of[i]] >= before[of[i]] > 0 for i in range(n)]

    def unimportant(self, own: np.ndarray, styles: np.ndarray, threshold: float) -> list[bool]:
        """For each element whether nothing in its branch reaches the threshold."""
        n = len(self.tags)
        whole = own.astype(float).tolist()
        best = [0.0] * n
        for node in range(n - 1, -1, -1):
            below = self.children[node]
            if below:
                share = FADE ** max(1, int(styles[node]))
                whole[node] = (1 - share) * whole[node] + share * sum(whole[c] for c in below) / len(below)
                # Text of its own counts in full, whatever inline elements repeat in it.
                text = float(own[node]) if any(map(str.strip, self.texts[node])) else 0.0
                best[node] = max(whole[node], text, *[best[c] for c in below])
            else:
                best[node] = whole[node]
        return [b < threshold for b in best]

    def main_text(self, cut: list[bool], pages: np.ndarray) -> tuple[str, int]:
        """The blocks of the article, else of the page, without the branches to cut; and how many these were."""
        noisy = [self.noise(n, False) for n in range(len(self.tags))]
        articles, spared, cards = self.chosen(cut, noisy)
        cut = self.cuts(articles, cut, noisy, pages)
        blocks: list[str] = []
        parts: list[str] = []
        skip = inside = removed = 0

        def flush() -> None:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append(text)

        for at, text in self.events:
            node = at if at >= 0 else -1 - at
            if text is not None:
                if not skip and (inside or not articles):
                    parts.append(text)
                continue
            tag, opens = self.tags[node], at >= 0
            if tag in BLOCKS:
                if not skip:
                    flush()
            elif tag in SPACED and not skip:
                parts.append(" ")
            if opens:
                if node in articles and not skip:
                    inside += 1
                if skip:
                    skip += 1
                elif node in cards and node not in articles:
                    skip = 1
                elif noisy[node] and node not in articles and node not in spared and (not inside or self.noise(node, True)):
                    # An article in noisy surroundings was only chosen if there is no other; it is reached all the same.
                    skip = 1 if not self._holds(node, articles) else 0
                elif cut[node] and (inside or not articles):
                    skip = 1
                    removed += 1
            else:
                if skip:
                    skip -= 1
                elif node in articles:
                    inside -= 1
        flush()
        return "\n\n".join(blocks), removed

    def _holds(self, node: int, wanted: set[int]) -> bool:
        for n in wanted:
            while n > node:
                n = self.parents[n]
            if n == node:
                return True
        return False


def place_rows(pages: DataFrame) -> DataFrame:
    """Of (site, html): (place, kind, value) for each element with children (kind 0, its style) or text (1, its content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = []
                for site, html in zip(part.column("site").to_pylist(), part.column("html").to_pylist()):
                    place, style, content = Tree(html).places(site)
                    for kind, value in ((0, style), (1, content)):
                        here = value != 0
                        found.append((place[here], np.full(int(here.sum()), kind, np.int32), value[here]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["place", "kind", "value"])

    return pages.select("site", "html").mapInArrow(run, "place bigint, kind int, value bigint")


def importance(rows: DataFrame) -> DataFrame:
    """(place, importance, styles, pages) for the places of several pages that are below full importance.

    With c pages for each of l values and m in all, the entropy of styles is 1 - sum(c ln c) / (m ln m), and the
    importance of contents 1 - sum(ln c) / (l ln m).  A place with both has the larger one.
    """
    counted = rows.groupBy("place", "kind", "value").agg(F.count("*").alias("c"))
    logs = F.log(F.col("c").cast("double"))
    summed = counted.groupBy("place", "kind").agg(
        F.sum("c").alias("m"), F.sum(F.col("c") * logs).alias("weighted"), F.sum(logs).alias("plain"), F.count("*").alias("l")
    )
    several = summed.where("m > 1")
    size = F.log(F.col("m").cast("double"))
    style = 1 - F.col("weighted") / (F.col("m") * size)
    content = 1 - F.col("plain") / (F.col("l") * size)
    own = several.select("place", F.round(F.when(F.col("kind") == 0, style).otherwise(content), 6).alias("own"), "kind", "l", "m")
    found = own.groupBy("place").agg(
        F.max("own").alias("importance"), F.max(F.when(F.col("kind") == 0, F.col("l"))).alias("styles"), F.max("m").alias("pages")
    )
    return found.where("importance < 1").select(
        "place", F.col("importance").cast("float"), F.coalesce("styles", F.lit(1)).cast("int").alias("styles"), F.col("pages").cast("int")
    )


def _table(rows: list) -> tuple[np.ndarray, ...]:
    rows = sorted(tuple(r) for r in rows)
    return tuple(np.array([r[i] for r in rows], kind) for i, kind in enumerate((np.int64, np.float32, np.int32, np.int32)))


def _looked_up(places: np.ndarray, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known, values, styles, counts = table
    own, several, pages = np.ones(len(places)), np.ones(len(places), int), np.ones(len(places), int)
    if len(known):
        at = np.minimum(np.searchsorted(known, places), len(known) - 1)
        hit = known[at] == places
        own[hit], several[hit], pages[hit] = values[at[hit]], styles[at[hit]], counts[at[hit]]
    return own, several, pages


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD,
            most_sent: int = MOST_SENT) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_removed.

    ``text`` has the blocks of the main text in page order, joined by two line feeds; character references are decoded
    and white space within a block is one space.  ``n_removed`` counts branches cut for low importance.  Null, empty and textless html gives an empty text.  Pages without a host are no part of a site.
    Pages repeated count each time in their site's tree, and each gets its row.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("site", host(F.col("url")))
    sited = rows.where("site IS NOT NULL AND html <> ''")
    found = stage(importance(place_rows(sited)), "site-places")
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_removed int"
    if found.count() <= most_sent:
        sent = pages.sparkSession.sparkContext.broadcast(_table(found.collect()))
        return _finished(rows.mapInArrow(_extractor(threshold, lambda part: [sent.value] * part.num_rows), schema))
    # Too many to send: each page (told by site and html) gets the places it has.
    rows = rows.withColumn("digest", F.sha2("html", 256))
    own = _page_places(rows.where("site IS NOT NULL AND html <> ''")).join(found, "place")
    lists = own.groupBy("site", "digest").agg(F.collect_list(F.struct("place", "importance", "styles", "pages")).alias("known"))
    lists = lists.select(F.col("site").alias("of_site"), F.col("digest").alias("of"), "known")
    joined = rows.join(lists, (F.col("digest") == F.col("of")) & (F.col("site") == F.col("of_site")), "left")
    joined = joined.select("page_id", "url", "site", "html", "known")

    def given(part: pa.RecordBatch) -> list:
        return [_table([tuple(x.values()) for x in known or []]) for known in part.column("known").to_pylist()]

    return _finished(joined.mapInArrow(_extractor(threshold, given), schema))


def _page_places(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lists = [
                    np.unique(Tree(h).places(s)[0])
                    for s, h in zip(part.column("site").to_pylist(), part.column("html").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("site"), part.column("digest"), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))],
                    ["site", "digest", "places"],
                )

    once = rows.select("site", "digest", "html").mapInArrow(run, "site string, digest string, places array<bigint>")
    return once.select("site", "digest", F.explode("places").alias("place")).distinct()


def _extractor(threshold: float, tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts, removed = [], []
                for site, html, table in zip(part.column("site").to_pylist(), part.column("html").to_pylist(), tables(part)):
                    tree = Tree(html)
                    seen = _looked_up(tree.places(site or "")[0], table) if site is not None else (np.ones(len(tree.tags)),) * 3
                    own, styles, on_pages = seen
                    text, cuts = tree.main_text(tree.unimportant(own, styles, threshold), on_pages)
                    texts.append(text)
                    removed.append(cuts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(removed, pa.int32())],
                    ["page_id", "url", "text", "n_removed"],
                )

    return run


def _finished(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_removed")
