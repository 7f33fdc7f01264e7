"""HTML extraction by equivalence classes of template tokens.

A page is a sequence of elements, each with its path of open elements, and of texts. Over the different pages of a host every
element path, and every text at its path, has an occurrence vector: how often it stands in each page. Tokens with equal vectors
form an equivalence class; a class is valid if it has CLASS tokens or more (an element's two tags are two) and stands in SUPPORT
of the host's pages or more. Vectors are compared by a hash that is a sum over pages, so a class is found by counting, with
partial sums first, and a host that has a third of all pages is no hot key. Valid classes are nested by their paths: an element
is of the template if its class is valid and what encloses it is of the template. Between the template's tokens are its slots.

The main slot is found by going down the nested template: from an element to the one inside it that stands once in a page and
holds MAIN of the text (an article or main element already with HINT of it), as long as there is one. Its text is the main text,
less elements that say they are menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts or styles, and less
texts of valid classes that stand in SURE of the host's pages and in LEAST pages or more: a notice in every article is template,
though nothing names it so. A page most of whose slot would go this way is a near copy of the others and keeps its text. Pages
that lack the main slot, and hosts with one page, which have no template, give their article or main element, or without one all
outside the named elements that is not of a valid class.

Null and empty html gives an empty text. A url without a host, or null, is a host of its own name. Equal pages of a host count
once, and repeated rows give equal results. An empty table gives an empty result; extra columns are left alone. Pages are read
whole; unclosed elements end with what encloses them.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import small_enough, stash, text_of, unstash

CLASS, SUPPORT = 3, 0.5
MAIN, HINT = 0.5, 0.2
SURE, LEAST = 0.9, 5
#: Templates of so many bytes at most are broadcast to the pages.
SMALL = 64 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|$)", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements without content, with raw content, that stand within a line, and that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
APART = frozenset("head nav header footer aside form script style noscript template iframe object svg canvas button select option textarea dialog menu menuitem title".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Numbers in names that tell pages apart, not kinds of elements.
LONG = re.compile(r"\d{3,}")
BLOCKS = frozenset("address article aside blockquote body div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of a class, id or role that mark what is not main text, and words that may stand beside them in a name.
ROLES = frozenset("ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent notice notices comment comments disqus replies respond sidebar menu menus nav navbar navigation breadcrumb breadcrumbs header footer masthead sharing social related recommended recommendations newsletter subscribe signup login popup modal overlay toolbar pagination pager widget widgets copyright complementary contentinfo".split())
BESIDE = frozenset("box list bar block section area wrapper wrap container inner outer top bottom left right side page site main post article primary secondary global user reader readers link links item items form module unit slot text holder row col google share".split())
PART = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")


@lru_cache(maxsize=50_000)
def named_apart(names: str) -> bool:
    """Whether one of an element's names says that it is not main text: made of words of ROLES and of BESIDE only."""
    for name in names.split():
        words = [w.lower() for w in PART.split(name) if w and not w.isdigit()]
        if any(w in ROLES for w in words) and all(w in ROLES or w in BESIDE for w in words):
            return True
    return False


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(F.when(host != "", host), url, F.lit(""))


def parse(page: str) -> Iterator[tuple[str, str, int, bool]]:
    """(kind, path, value, state): kind is tag or text or gap; state says article (2), apart (1) or neither (0)."""
    stack: list[tuple[str, str, int]] = []  # element, path, state
    end, i = len(page), 0
    state, path = 0, ""
    while i < end:
        m = TOKEN.search(page, i)
        stop = m.start() if m else end
        if stop > i:
            yield "text", path, page[i:stop], state
        if not m:
            return
        i = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if at is not None and not (name in INLINE and any(s[0] in BLOCKS for s in stack[at + 1 :])):
                del stack[at:]
                path, state = (stack[-1][1], stack[-1][2]) if stack else ("", 0)
            if name not in INLINE:
                yield "gap", path, "", state
            continue
        names = " ".join(x for g in NAMED.findall(m[3]) for x in g if x) if m[3] else ""
        if name in CLOSES or name in BLOCKS:
            shut = CLOSES.get(name, set()) | ({"p"} if name in BLOCKS else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE and stack[k][0] != "p":
                    break
            path, state = (stack[-1][1], stack[-1][2]) if stack else ("", 0)
        label = name + "." + LONG.sub("0", names).replace("/", "|") if names else name
        here = path + "/" + label
        yield "tag", here, "", state
        if name not in INLINE:
            yield "gap", here, "", state
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        inner = state
        if name in APART or names and name not in ("html", "body", "article", "main") and named_apart(names):
            inner = 1
        elif name in ("article", "main") and state != 1:
            inner = 2
        if name in RAW:
            close = re.compile(f"</{name}[^>]*>", re.I).search(page, i)
            i = close.end() if close else end
            continue
        stack.append((name, here, inner))
        path, state = here, inner


def token(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - (1 << 63)


def text_token(path: str, value: str) -> int:
    return token(f"{path}#{xxhash.xxh64_hexdigest(' '.join(value.split()))}")


def enclosing(path: str) -> str:
    return path[: path.rfind("/")]


def tokens_of(page: str) -> dict[int, list[int]]:
    """Of each token of the page: [1 for a text or 2 for an element, what encloses it, 1 for article or main, how often it
    stands there, millionths of the page's text that is not apart in it]."""
    counts: dict[str, int] = {}
    chars: dict[str, int] = defaultdict(int)
    seen: dict[int, list[int]] = {}
    for kind, path, value, state in parse(page):
        if kind == "tag":
            counts[path] = counts.get(path, 0) + 1
        elif kind == "text" and state != 1 and (text := value.strip()):
            chars[path] += len(text)
            seen.setdefault(text_token(path, text), [1, token(path), 0, 0, 0])[3] += 1
    total = max(1, sum(chars.values()))
    for path, n in list(chars.items()):
        while path := enclosing(path):
            chars[path] += n
    for path, n in counts.items():
        hint = path[path.rfind("/") + 1 :].split(".", 1)[0] in ("article", "main")
        seen[token(path)] = [2, token(enclosing(path)) if enclosing(path) else 0, int(hint), n, chars.get(path, 0) * 1_000_000 // total]
    return seen


FIELDS = ["host", "token", "kind", "parent", "hint", "pages", "vector", "once", "chars"]


def occurrences(df: DataFrame) -> DataFrame:
    """Of every host's tokens (0 stands for the page): host, token, kind, parent, hint, pages it is in, vector (a sum over pages,
    so equal for equal occurrence vectors), pages in which it stands once, chars (shares of the pages' text, so a long page has no more weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = [[k[0] for k in held], [k[1] for k in held], *([v[i] for v in held.values()] for i in range(7))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)], FIELDS)

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = page.as_py()
                mark = xxhash.xxh64_intdigest(page) >> 34
                for t, (kind, parent, hint, n, chars) in {**tokens_of(page), 0: [0, 0, 0, 1, 0]}.items():
                    have = held.get((host, t))
                    if have is None:
                        held[host, t] = [kind, parent, hint, 1, mark * n, int(n == 1), chars]
                    else:
                        have[3] += 1
                        have[4] += mark * n
                        have[5] += n == 1
                        have[6] += chars
                if len(held) > 200_000:
                    yield out()
                    held.clear()
        yield out()

    rows = df.select(host_of(F.col("url")).alias("host"), text_of(df, "html").alias("html"))
    rows = rows.withColumns({"c": F.xxhash64("html"), "e": F.xxhash64(F.lit("page"), "html")})
    key = ["host", "c", "e"]
    copied = stash(rows.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1").select(key))
    copied = small_enough(copied)
    # only pages that stand more than once are shuffled
    once = rows.join(copied, key, "left_anti").select("host", "html")
    rows = once.union(rows.join(copied, key, "left_semi").groupBy(key).agg(F.first("html").alias("html")).select("host", "html"))
    found = rows.mapInArrow(run, "host string, " + ", ".join(f"{x} long" for x in FIELDS[1:]))
    sums = [F.sum(x).alias(x) for x in ("pages", "vector", "once", "chars")]
    return found.groupBy("host", "token").agg(F.first("kind").alias("kind"), F.first("parent").alias("parent"), F.first("hint").alias("hint"), *sums)


def deduce(tokens: list[dict], total: int) -> tuple[int | None, list[int], list[int]]:
    """Of one host's tokens: its main slot's element, the texts of valid classes, and those that are template in the main slot."""
    classes: dict[tuple[int, int], list[dict]] = defaultdict(list)
    for t in tokens:
        classes[t["pages"], t["vector"]].append(t)
    valid = [t for c in classes.values() if sum(t["kind"] for t in c) >= CLASS for t in c]
    inside: dict[int, list[dict]] = defaultdict(list)
    for t in valid:
        if t["kind"] == 2:
            inside[t["parent"]].append(t)
    main, held = None, sum(t["chars"] for t in inside[0])
    while True:
        # what is reached from the root through elements of valid classes is the nested template
        slots = [t for t in inside[main or 0] if t["once"] >= SURE * t["pages"] and t["chars"] >= (HINT if t["hint"] else MAIN) * held > 0]
        if not slots:
            break
        best = max(slots, key=lambda t: (t["hint"], t["chars"], t["token"]))
        main, held = best["token"], best["chars"]
    texts = sorted(t["token"] for t in valid if t["kind"] == 1)
    sure = sorted(t["token"] for t in valid if t["kind"] == 1 and t["pages"] >= max(LEAST, SURE * total))
    return main, texts, sure


def templates(df: DataFrame) -> DataFrame:
    """One row per host with a template: host, main (token of the main slot's element), texts, sure."""
    often = stash(occurrences(df).where("pages > 1"))  # what one page alone has is no template
    total = often.where("token = 0").select("host", F.col("pages").alias("total"))
    # a host's tokens that are in half of its pages are at most twice as many as a page has in the mean
    rows = often.where("token <> 0").join(total, "host").where(F.col("pages") >= SUPPORT * F.col("total"))

    def run(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        main, texts, sure = deduce(found.drop_columns(["host"]).sort_by("token").to_pylist(), found.column("total")[0].as_py())
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array([x], k) for x, k in zip((key[0].as_py(), main, texts, sure), kinds)], ["host", "main", "texts", "sure"])

    found = stash(rows.groupBy("host").applyInArrow(run, "host string, main long, texts array<long>, sure array<long>"))
    unstash(often)
    return found


def main_text(page: str, main: int | None, texts: set[int], sure: set[int]) -> str:
    """The page's main slot; without one its article; without one all that is not apart, less texts of valid classes."""
    slots: tuple[list[str], ...] = ([], [], [])
    inside: dict[str, bool] = {"": False}
    held: list[str] = []
    where = gone = 0

    def within(path: str) -> bool:
        if path not in inside:
            inside[path] = token(path) == main or within(enclosing(path))
        return inside[path]

    def close() -> None:
        if held:
            if text := " ".join(entities.unescape("".join(held)).split()):
                slots[where].append(text)
            held.clear()

    for kind, path, value, state in parse(page):
        if kind == "gap":
            close()
        elif kind == "text" and state == 1:
            close()
        elif kind == "text":
            at = 2 if main is not None and within(path) else 1 if state == 2 else 0
            if at != where:
                close()
                where = at
            known = sure if at == 2 else texts if at == 0 else ()
            own = bool(known) and bool(value.strip()) and text_token(path, value.strip()) in known
            gone += len(value.strip()) if own and at == 2 else 0
            held.append(" " if own else value)
    close()
    if gone > sum(map(len, slots[2])):
        return main_text(page, main, texts, set())
    return " ".join(next((s for s in reversed(slots) if s), ()))


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = templates(df)
    size = found.agg(F.coalesce(F.sum(F.length("host") + 8 * (F.size("texts") + F.size("sure")) + 64), F.lit(0))).first()[0]
    kind = df.schema["page_id"].dataType.simpleString()
    rows = df.select("page_id", "url", text_of(df, "html").alias("html"), host_of(F.col("url")).alias("host"))
    # beyond a broadcast, a host with many pages is one row against many, which a skewed join may split
    rows = rows.join(F.broadcast(found) if size <= SMALL else found.hint("merge"), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int | None, set[int], set[int]]] = {}
        for batch in batches:
            out = []
            for host, page, main, texts, sure in zip(batch.column(3).to_pylist(), batch.column(2), *batch.columns[4:]):
                if host not in held:
                    if len(held) > 1000:
                        held.clear()
                    held[host] = (main.as_py(), set(texts.as_py() or ()), set(sure.as_py() or ()))
                out.append(main_text(page.as_py(), *held[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host", "main", "texts", "sure").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
