"""Main text of web pages: blocks by their place in the page, boilerplate by a suffix array over the pages of a host.

A page is cut into blocks.  Blocks inside navigation, headers, footers, forms,
adverts and the like are boilerplate by their place; blocks inside an article or
main element are content by theirs.  What stands elsewhere is decided by the
host: the token streams of its pages, articles included, are concatenated, their
suffixes sorted, and every run of tokens that starts a suffix outside the article
on two distinct pages of the host, and inside an article on none, is boilerplate;
only the runs between are kept.  Text of an article is never cut for being
repeated: copied articles are content, and so are copies that stand elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import materialize, ready, slices
from mercato.llm.sieve import held, mark

CONTENT, BOILERPLATE, OPEN = 0, 1, 2

#: Elements whose text is never page text (raw: up to their end tag, without inner markup).
_RAW = frozenset("script style noscript template textarea iframe xmp noembed noframes title svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text.
_ASIDE = frozenset("head nav header footer aside form menu dialog button select option fieldset label object audio video canvas map datalist legend".split())
_MAIN = frozenset(("article", "main"))
#: Elements that do not end a block.
_INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small
span strike strong sub sup time tt u var br wbr img""".split())
#: Words in class, id or role that mark such parts.
_MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner sidebar menu nav navbar
navigation header masthead footer notice notices cookie cookies consent gdpr alert comment comments reply replies respond disqus share sharing social
related breadcrumb breadcrumbs pagination pager popup modal overlay newsletter subscribe subscription signup login search widget widgets
complementary contentinfo form dialog skip toolbar""".split())

_TOKEN = regex.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|[^<]+|<""", regex.S)
_ATTR = regex.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", regex.I)
_PARTS = regex.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {t: regex.compile(rf"</{t}\s*>|\Z", regex.I) for t in _RAW}
#: Elements an opening tag closes if they are open and innermost.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _marked(tag: str, attrs: str) -> bool:
    if tag in _ASIDE:
        return True
    if tag in _MAIN or tag in ("body", "html") or not attrs:
        return False
    return any(p.lower() in _MARKS for m in _ATTR.finditer(attrs) for p in _PARTS.split(m[2] or m[3] or m[4] or ""))


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, kind) of every block with text, in page order; white space inside is one space."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, inside boilerplate, inside the main element
    at = 0

    def flush() -> None:
        said = " ".join(unescape("".join(text)).split())
        text.clear()
        if said:
            _, aside, main = stack[-1] if stack else ("", False, False)
            out.append((said, BOILERPLATE if aside else CONTENT if main else OPEN))

    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if html[m.start()] != "<" or m.end() - m.start() == 1:
                text.append(m[0])
            continue
        tag = tag.lower()
        if m["end"]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            # an inline end tag does not close the blocks opened since
            if i < 0 or tag in _INLINE and any(t not in _INLINE for t, _, _ in stack[i + 1:]):
                if tag == "p":
                    flush()
                continue
            if tag not in _INLINE or stack[i][1] != (i > 0 and stack[i - 1][1]):
                flush()
            del stack[i:]
            continue
        if tag in _RAW:
            if not m["attrs"].rstrip().endswith("/"):
                at = _RAW_END[tag].search(html, at).end()
            text.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        _, aside, main = stack[-1] if stack else ("", False, False)
        marked = _marked(tag, m["attrs"])
        if tag not in _INLINE:
            flush()
            while stack and stack[-1][0] in _CLOSES.get(tag, ()):
                stack.pop()
            if tag == "p":  # a paragraph ends the one before, with what it left open
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _INLINE), -1)
                if i >= 0 and stack[i][0] == "p":
                    del stack[i:]
            elif tag == "body":
                del stack[:]
            _, aside, main = stack[-1] if stack else ("", False, False)
        elif marked and not aside:
            flush()
        stack.append((tag, aside or marked, main or tag in _MAIN))
    flush()
    return out


def suffix_classes(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``tokens`` sorted by their first ``depth`` tokens, and the class of each suffix (equal prefixes, equal class).

    Prefix doubling: ranks by 1, 2, 4 ... tokens, the last step reaches exactly ``depth``.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while k < depth:
        step = min(k, depth - k)
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:] if step < len(rank) else 0
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        k += step
    return np.argsort(rank, kind="stable"), rank


def _by_size(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices with about ``most`` characters of blocks, one page at least."""
    for batch in batches:
        start, total = 0, 0
        for i, size in enumerate(batch.column("size").to_pylist()):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows:
            yield batch.slice(start)


def _key(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words))


def _open_rows(depth: int):
    """Every run of ``depth`` tokens of an undecided block, by its place in the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_size(batches):
            row, start, keys = [], [], []
            for i, parts in enumerate(batch.column("blocks").to_pylist()):
                n = 0
                for p in parts:
                    ws = p["text"].split(" ")
                    if p["kind"] == OPEN:
                        for at in range(len(ws) - depth + 1):
                            row.append(i)
                            start.append(n + at)
                            keys.append(_key(ws[at:at + depth]))
                    n += len(ws)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("uid").take(rows), batch.column("host").take(rows), pa.array(start, pa.int32()),
                pa.array(np.array(keys, np.uint64).view(np.int64))], ["uid", "host", "start", "key"])

    return run


def _suffix_rows(depth: int, asked: np.ndarray):
    """Per slice of pages: the runs of ``depth`` tokens that start a suffix and may be ``asked`` for, once per page and side of its article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_size(batches):
            ids: dict[str, int] = {}
            stream, page, main, words_of = [], [], [], []
            for i, parts in enumerate(batch.column("blocks").to_pylist()):
                for p in parts:
                    ws = p["text"].split(" ")
                    stream += [ids.setdefault(w, len(ids)) for w in ws]
                    # the end of a block ends its runs: a mark that equals no other token
                    stream.append(-len(stream) - 1)
                    words_of += [*ws, ""]
                    page += [i] * (len(ws) + 1)
                    main += [p["kind"] == CONTENT] * (len(ws) + 1)
            if not stream:
                continue
            tokens, page, main = np.array(stream), np.array(page), np.array(main)
            order, cls = suffix_classes(tokens, depth)
            marks = np.concatenate([[0], np.cumsum(tokens < 0)])
            whole = np.zeros(len(tokens), bool)
            n = len(tokens) - depth + 1
            if n > 0:
                whole[:n] = marks[depth:] == marks[:n]  # no block end within
            order = order[whole[order]]
            if not len(order):
                continue
            # one key per class, from its first suffix in the array
            first = np.concatenate([[True], cls[order][1:] != cls[order][:-1]])
            keys = np.array([_key(words_of[i:i + depth]) for i in order[first]], np.uint64)[np.cumsum(first) - 1]
            order, keys = (x[held(asked, keys)] for x in (order, keys))
            seen = np.unique(np.stack([keys.view(np.int64), page[order], main[order]]), axis=1)
            rows = pa.array(seen[1])
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id").take(rows), batch.column("host").take(rows), pa.array(seen[2] > 0), pa.array(seen[0])],
                ["page_id", "host", "main", "key"])

    return run


def _assemble(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for parts, starts in zip(b.column("blocks").to_pylist(), b.column("starts").to_pylist()):
                covered = {s + i for s in starts or () for i in range(depth)}
                kept, n = [], 0
                for p in parts:
                    ws = p["text"].split(" ")
                    if p["kind"] == CONTENT:
                        kept.append(p["text"])
                    elif p["kind"] == OPEN:
                        kept += [w for i, w in enumerate(ws, n) if i not in covered]
                    n += len(ws)
                texts.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def parse(pages: DataFrame) -> DataFrame:
    """``page_id, url, uid, host, blocks, size``: every block of every page with its kind, and the characters of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int32())]))
        for b in slices(batches, "html"):
            found = [blocks(h or "") for h in b.column("html").to_pylist()]
            parts = [[{"text": t, "kind": k} for t, k in x] for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(parts, kind), pa.array([sum(len(t) for t, _ in x) for x in found], pa.int64())],
                ["page_id", "url", "blocks", "size"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    parsed = pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {id_type}, url string, blocks array<struct<text string, kind int>>, size long")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return parsed.select("page_id", "url", F.monotonically_increasing_id().alias("uid"), host.alias("host"), "blocks", "size")


def extract(pages: DataFrame, min_tokens: int = 8) -> DataFrame:
    """``page_id, url, text, n_chars`` per input row.

    ``min_tokens``: shortest run that counts as repeated between two distinct
    page_ids of a host, outside their articles.  The suffix array is built per task over the pages it
    holds and its classes are merged across tasks as partial aggregates by (host,
    key), so a host with a third of all pages is no hot task and no repeat is
    missed.  Null html is an empty page; a null or odd url belongs to host "".
    Repeated rows of one page_id are one page to the host but give a row each.
    Unclosed elements end with their parent; a cut-off page keeps what it has.
    """
    ready(pages.sparkSession)
    parsed = materialize(parse(pages))
    id_type = pages.schema["page_id"].dataType.simpleString()
    undecided = parsed.where(F.exists("blocks", lambda x: x["kind"] == OPEN))
    runs = materialize(undecided.select("uid", "host", "blocks", "size").mapInArrow(_open_rows(min_tokens), "uid long, host string, start int, key long"))
    # all text of all pages bears witness; the sieve keeps back runs that no undecided block has
    seen = parsed.select("page_id", "host", "blocks", "size").mapInArrow(
        _suffix_rows(min_tokens, mark(runs)), f"page_id {id_type}, host string, main boolean, key long")
    outside = F.when(~F.col("main"), F.col("page_id"))
    repeated = (seen.groupBy("host", "key").agg(F.min(outside).alias("a"), F.max(outside).alias("b"), F.max("main").alias("main"))
                .where("a <> b AND NOT main").select("host", "key"))
    starts = runs.join(repeated, ["host", "key"]).groupBy("uid").agg(F.collect_set("start").alias("starts"))  # starts of one page
    found = undecided.join(starts, "uid", "left").select("page_id", "url", "blocks", "starts").unionByName(
        parsed.where(~F.exists("blocks", lambda x: x["kind"] == OPEN)).select(
            "page_id", "url", "blocks", F.lit(None).cast("array<int>").alias("starts")))
    texts = found.mapInArrow(_assemble(min_tokens), f"page_id {id_type}, url string, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
