"""Main text of web pages from suffix arrays over the token streams of a host's pages.

A page is cut into blocks: the text between block-level tags, with its container (the tags and
class names around it).  A page is a stream of tokens, for every block a token of its container and
its words.  The suffixes of all pages are named by prefix doubling: the name by 2k tokens comes from
two names by k tokens, up to ``DEPTH`` tokens and the host.  The names are ordered, and every run of
equal ones that lies on distinct pages marks its tokens as repeated (the union of all substrings of
that length or more that repeat on the host).  Blocks mostly covered by repeated tokens are
boilerplate, unique runs are kept.  An exact check by the markup follows, for what repetition alone
gets wrong: copies of an article repeat and stay, menus, adverts or reader comments may be unique and
go; where a page names its article, the text is what lies in it.  A page repeated throughout is a copy
of another one and loses only what the markup names.

Names are dealt out by their value to buckets of about ``SHARD`` characters of html, whatever their
host, so a large host is no large task, and what repeats on it is found wherever its pages lie: size
and dealing change no result.  A task sends a name once for about ``SENT`` names, with a bit that tells
whether it lies on several of their pages; sorted names are sent as compressed differences.  Rows of one
host and html are found first, by a hash; only their names come with the 32 bits that tell pages apart.

Every page is judged by its repeated names: pages lie in compressed frames of about ``FRAME`` bytes of
html, dealt out once; the names of a frame go to the buckets, which send back those that repeat, and
there they meet the frame again.  To send fewer bytes, the first 40 bits of all names are compared first:
names that repeat do so in them.  The names whose bits repeat are then compared whole, and those that
don't repeat are sent back, some 1 in 30,000 of all on 30 million names.

Defined cases: a null html is empty and gives an empty text; a null url has the empty host; repeated
rows are rows of their own, equal pages count as one page; a page without markup is one block;
white space is space, tab, line feed, vertical tab, form feed and carriage return; unclosed tags end
with the tags around them, an unclosed comment, script or style with the page; an empty table gives
no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from corpusbank.llm.common import table
from corpusbank.llm.host_reputation import url_host
from corpusbank.llm.words import STEP, mix, word_hashes
from corpusbank.session import stage

SHARD = 16_000_000  # characters of html whose names make a bucket
FRAME = 32_000_000  # bytes of html in a frame
CHUNK = 4_000_000  # bytes of html parsed at once
SENT = 4_000_000  # names held before they are sent
SHORT = np.uint64(0xFFFFFFFFFF000000)  # bits of a name that are compared first
DEPTH = 8  # tokens of a repeated substring, at least
COVERED = 0.75  # share of a block's words
COPY = 0.9  # share of a page's words

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold no main text.
DROPPED = frozenset(
    "nav footer aside form head menu dialog template noscript svg math button select optgroup "
    "option datalist object audio video canvas map fieldset".split()) | RAW
#: Words of class, id and role that name such elements.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav "
    "navbar navigation menu breadcrumb breadcrumbs sidebar complementary footer contentinfo cookie "
    "cookies consent gdpr notice notices alert popup modal dialog newsletter subscribe "
    "subscription signup login share sharing social related recommended pagination pager comment "
    "comments disqus respond reply replies widget toolbar masthead search form hidden".split())
#: Class, id or role of an article where no element of that kind is used.
ARTICLE = frozenset(
    "article article-body articlebody article-content post post-content post-body entry "
    "entry-content main main-content content story story-body".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dd": ("dd dt", ("dl",)),
          "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
          "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
SPACES = re.compile(r"[\x20\x09-\x0D]+")
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>)|[^>]*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true""", re.I)

OTHER, ARTICLE_TEXT, MAIN_TEXT, OUT = range(4)


class _Open:
    """An open element: its container key and what its text counts as."""

    __slots__ = ("tag", "key", "kind")

    def __init__(self, tag: str, key: int, kind: int):
        self.tag, self.key, self.kind = tag, key, kind


def _kind(tag: str, attributes: str, parent: int) -> tuple[int, str]:
    """(what an element's text counts as, its class names)."""
    names = " ".join(a or b or c for a, b, c in NAMED.findall(attributes)).lower() \
        if "=" in attributes else ""
    if parent == OUT or tag in DROPPED:
        return OUT, names
    if tag in ("html", "body"):
        return parent, names
    if tag == "article" or "articlebody" in names:
        return ARTICLE_TEXT, names
    if tag == "main":
        return max(parent, MAIN_TEXT) if parent != ARTICLE_TEXT else parent, names
    if tag == "header":
        return (parent if parent == ARTICLE_TEXT else OUT), names
    if attributes and HIDDEN.search(attributes):
        return OUT, names
    if names:
        if not NAMES.isdisjoint(re.split(r"[^a-z0-9]+", names)):
            return OUT, names
        if parent == OTHER and not ARTICLE.isdisjoint(names.split()):
            return MAIN_TEXT, names
    return parent, names


def blocks(page: str) -> list[tuple[int, int, str]]:
    """(container key, kind, text) of the page's blocks in order, markup removed."""
    out: list[tuple[int, int, str]] = []
    stack = [_Open("", 0, OTHER)]
    text: list[str] = []
    at, end = 0, len(page)

    def flush():
        if text:
            whole = SPACES.sub(" ", "".join(text)).strip(" ")
            text.clear()
            if whole:
                out.append((stack[-1].key, stack[-1].kind, whole))

    def say(piece: str):
        if piece and stack[-1].kind != OUT or piece and stack[-1].tag in BLOCKS:
            text.append(html.unescape(piece) if "&" in piece else piece)

    while at < end:
        found = TAG.search(page, at)
        if found is None:
            say(page[at:])
            break
        say(page[at:found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        tag = name.lower()
        block = tag in BLOCKS
        if tag == "br":
            say("\n")
        if block:
            flush()
        if found[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                if any(o.tag in BLOCKS for o in stack[depth:]):
                    flush()
                del stack[depth:]
            continue
        if block:
            if stack[-1].tag == "p":
                stack.pop()
            closes, scope = CLOSES.get(tag, ("", ()))
            for k in range(len(stack) - 1, 0, -1) if closes else ():
                if stack[k].tag in scope:
                    break
                if stack[k].tag in closes.split():
                    del stack[k:]
                    break
        if tag in VOID or found[3].endswith("/") and not block and tag not in RAW:
            continue
        kind, names = _kind(tag, found[3], stack[-1].kind)
        if block or kind == OUT != stack[-1].kind:
            key = zlib.crc32(f"{tag}.{names}".encode("utf-8", "surrogatepass"), stack[-1].key)
            stack.append(_Open(tag, key, kind))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else end
    flush()
    return out


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Place of every suffix when suffixes are ordered by their first ``depth`` tokens.

    Prefix doubling: after a round, places by 2k tokens come from the pairs of places by k tokens.
    Suffixes that agree on ``depth`` tokens share their place; ``depth`` is a power of two.
    """
    place = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    known = 1
    while known < depth:
        behind = np.zeros_like(place)
        behind[:-known] = place[known:] + 1
        place = np.unique(place * (behind.max(initial=0) + 1) + behind, return_inverse=True)[1]
        known *= 2
    return place


def repeated(tokens: np.ndarray, page: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """True for tokens inside a substring of ``depth`` tokens that lies on distinct pages.

    ``page`` numbers the pages; a page ends with a token that occurs nowhere else, so no repeated
    substring crosses it.
    """
    if not len(tokens):
        return np.zeros(0, dtype=bool)
    place = suffix_ranks(tokens, depth)
    order = np.argsort(place, kind="stable")
    starts = np.flatnonzero(np.diff(place[order], prepend=-1))
    least, most = (f.reduceat(page[order], starts) for f in (np.minimum, np.maximum))
    shared = np.repeat(least != most, np.diff(np.append(starts, len(order))))
    return _covered(len(tokens), order[shared], depth)


def _streams(pages: list[list[tuple[int, int, str]]]):
    """(tokens, their pages, which are words, block starts, words of each block) of all pages.

    A page ends with a token that occurs nowhere else.
    """
    found = [(key, n, text) for n, page in enumerate(pages) for key, _, text in page]
    words, counts = word_hashes([text for _, _, text in found])
    owner = np.array([n for _, n, _ in found], dtype=np.int64)
    last = np.diff(np.append(owner, -1)) != 0  # of its page
    size = counts + 1 + last
    start = np.cumsum(size) - size
    tokens = np.zeros(int(size.sum()), dtype=np.uint64)
    kind = np.zeros(len(tokens), dtype=bool)  # words
    tokens[start] = mix(np.array([key for key, _, _ in found], dtype=np.uint64)
                        + np.uint64(1 << 40))
    at = np.repeat(start + 1 - (np.cumsum(counts) - counts), counts) + np.arange(len(words))
    tokens[at], kind[at] = words, True
    ends = (start + size - 1)[last]
    tokens[ends] = mix(np.arange(len(ends), dtype=np.uint64) + np.uint64(1 << 41))
    return tokens, np.repeat(owner, size), kind, start, counts


def _block_repeats(marked: np.ndarray, kind: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(marked & kind, start, dtype=np.int64) if len(start) else start


def covered_shares(pages: list[list[tuple[int, int, str]]], depth: int = DEPTH):
    """(words, repeated words) of every block of a host's pages, one after the other."""
    tokens, page, kind, start, counts = _streams(pages)
    return counts, _block_repeats(repeated(tokens, page, depth), kind, start)


def suffix_names(pages: list[list[tuple[int, int, str]]], hosts: list[str], depth: int = DEPTH):
    """:func:`_streams`, then (names, places): of every suffix of ``depth`` tokens of one page.

    Prefix doubling with names that mean the same in every task; equal suffixes of one host have
    equal names.
    """
    tokens, page, kind, start, counts = streams = _streams(pages)
    name, known = mix(tokens), 1
    while known < depth:
        behind = np.zeros_like(name)
        behind[:-known] = name[known:]
        name = mix(name * np.uint64(STEP) + mix(behind + np.uint64(known)))
        known *= 2
    closing = np.diff(np.append(page, -1)) != 0  # end tokens
    fits = page[:-depth + 1 or None] == page[depth - 1:]
    at = np.flatnonzero(fits & ~closing[depth - 1:]) if len(page) >= depth else np.zeros(0, int)
    own = text_hashes(hosts)
    return *streams, mix(name[at] ^ own[page[at]]), at


def text_hashes(texts: list[str]) -> np.ndarray:
    """64-bit hash of every whole text."""
    return np.array([int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                                    "big") for t in texts], dtype=np.uint64)


def _covered(size: int, first: np.ndarray, depth: int) -> np.ndarray:
    """True for tokens inside a substring of ``depth`` tokens that begins at ``first``."""
    marks = np.zeros(size + depth, dtype=np.int64)
    np.add.at(marks, first, 1)
    np.add.at(marks, first + depth, -1)
    return np.cumsum(marks)[:size] > 0


def article_kind(page: list[tuple[int, int, str]]) -> int | None:
    """What the main text of a page counts as; None where the markup doesn't name it."""
    kinds = {kind for _, kind, _ in page}
    return next((k for k in (ARTICLE_TEXT, MAIN_TEXT) if k in kinds), None)


def kept_blocks(pages: list[list[tuple[int, int, str]]], counts: np.ndarray, repeats: np.ndarray
                ) -> list[list[bool]]:
    """Which blocks of distinct pages are main text, by their words and repeated words."""
    covered = repeats >= COVERED * np.maximum(counts, 1)
    out, at = [], 0
    for page in pages:
        span = slice(at, at + len(page))
        at += len(page)
        kinds = np.array([kind for _, kind, _ in page], dtype=np.int64)
        free = kinds != OUT
        words = counts[span][free].sum()
        copy = words > 0 and repeats[span][free].sum() >= COPY * words
        unique = free & (~covered[span] | copy)
        named = article_kind(page)
        out.append((unique if named is None else kinds == named).tolist())
    return out


def _joined(page: list[tuple[int, int, str]], kept: list[bool]) -> str:
    return "\n".join(text for (_, _, text), k in zip(page, kept) if k)


def main_texts(pages: list[str | None], depth: int = DEPTH) -> list[str]:
    """The main text of every page of one host, all of them at hand."""
    distinct = {p: None for p in pages if p}
    parsed = [blocks(p) for p in distinct]
    for page, found, kept in zip(list(distinct), parsed,
                                 kept_blocks(parsed, *covered_shares(parsed, depth))):
        distinct[page] = _joined(found, kept)
    return [distinct[p] if p else "" for p in pages]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows together that have about ``most`` bytes of html."""
    held, total = [], 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch["_html"]), 0)
        size = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(size):
            before = size[at - 1] if at else 0
            end = int(np.searchsorted(size, before + max(most - total, 1))) + 1
            held.append(batch.slice(at, end - at))
            total += int(size[min(end, len(size)) - 1] - before)
            at = end
            if total >= most:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _distinct_names(names: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ascending distinct names, least and greatest tag of each)."""
    order = np.argsort(names, kind="stable")
    names, tags = names[order], tags[order]
    start = np.flatnonzero(np.diff(names, prepend=~names[:1]) != 0)
    if not len(start):
        return names, tags, tags
    return names[start], np.minimum.reduceat(tags, start), np.maximum.reduceat(tags, start)


def packed(names: np.ndarray) -> bytes:
    """Ascending 64-bit names: the bytes of their differences, a compressed block for each place."""
    steps = np.diff(names, prepend=np.uint64(0)).astype("<u8")
    out = zstandard.ZstdCompressor(level=1).compressobj(size=steps.nbytes)
    return b"".join(out.compress(place.tobytes()) + out.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
                    for place in steps.view(np.uint8).reshape(-1, 8).T) + out.flush()


def unpacked(data: bytes) -> np.ndarray:
    """The names of :func:`packed`."""
    steps = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(steps.T.copy().view("<u8").ravel(), dtype=np.uint64)


FRAMED = "_frame long, _pages binary"
BUCKETED = "_frame long, _bucket long, _copy boolean, _names binary, _tags binary"
SHARED = "_frame long, _wrong boolean, _names binary"


def _framed(batches):
    """Rows (hash of the frame, frame)."""
    for chunk in _chunks(batches, FRAME):
        sink = pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
        with pa.ipc.new_stream(sink, chunk.schema, options=options) as out:
            out.write_table(chunk.combine_chunks())
        data = sink.getvalue()
        own = int.from_bytes(blake2b(data, digest_size=8).digest(), "big", signed=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([own], pa.int64()), pa.array([data.to_pybytes()], pa.binary())], ["_frame", "_pages"])


def _pages(frame: bytes) -> list[pa.RecordBatch]:
    """The rows of a frame."""
    with pa.ipc.open_stream(frame) as rows:
        return list(rows)


def _dealt(names: np.ndarray, tags: np.ndarray, copy: bool, buckets: int):
    """Rows of :func:`_bucketed` for names of copies or of other pages."""
    names, least, most = _distinct_names(names, tags)
    twice = least != most
    sets = [(names, least), (names[twice], most[twice])] if copy else [(names, twice)]
    for values, tags in sets:
        bucket = ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        for a, b in zip(cut, [*cut[1:], len(values)]):
            told = tags[a:b] if copy else np.packbits(tags[a:b])
            yield int(bucket[a]), copy, packed(values[a:b]), told.tobytes()


def _bucketed(buckets: int, depth: int, short: bool = False, likely: np.ndarray | None = None):
    """Rows (bucket, whether of copies, names, tags).

    Names are cut to their ``SHORT`` bits, or left out if those aren't among the likely ones.

    The tags of names of copies are hashes of their pages; those of others are a bit for each name,
    set if it lies on several of the pages whose names are sent together.
    """
    def run(batches):
        held, size, seen = ([], []), 0, 0

        def sent():
            found = []
            for copy, kept in enumerate(held):
                names, tags = (np.concatenate(c) for c in zip(*kept))
                kept.clear()
                found += _dealt(names, tags, bool(copy), buckets)
            return pa.RecordBatch.from_arrays([
                pa.array([row[n] for row in found], kind) for n, kind in enumerate(
                    (pa.int64(), pa.bool_(), pa.binary(), pa.binary()))
            ], ["_bucket", "_copy", "_names", "_tags"])

        for chunk in _chunks(batches, CHUNK):
            rows = {(h, p): bool(c) for h, p, c in zip(
                *(chunk[c].to_pylist() for c in ("_host", "_html", "_copy"))) if p}
            parsed = [blocks(p) for _, p in rows]
            _, owner, _, _, _, names, at = suffix_names(parsed, [h for h, _ in rows], depth)
            copy = np.array([*rows.values()], dtype=bool)
            tag = np.arange(seen, seen + len(rows), dtype=np.uint32)
            tag[copy] = text_hashes([p for (_, p), c in rows.items() if c]) >> np.uint64(32)
            of = owner[at]
            if likely is not None:
                chosen = _among(names & SHORT, likely)
                names, of = names[chosen], of[chosen]
            if short:
                names = names & SHORT
            for kept, mine in zip(held, (~copy[of], copy[of])):
                kept.append((names[mine], tag[of[mine]]))
            size, seen = size + len(names), seen + len(rows)
            if size >= SENT:
                yield sent()
                size, seen = 0, 0
        if held[0]:
            yield sent()
    return run


def _sent(frames: pa.RecordBatch | pa.Table, *how) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_bucketed` for the pages of each frame, with the frame."""
    for own, data in zip(frames["_frame"].to_pylist(), frames["_pages"]):
        for rows in _bucketed(*how)(_pages(data.as_buffer())):
            yield pa.RecordBatch.from_arrays(
                [pa.array([own] * len(rows), pa.int64()), *rows.columns], ["_frame", *rows.schema.names])


def _sent_short(buckets: int, depth: int):
    """The short names of all pages."""
    def run(batches):
        for batch in batches:
            yield from _sent(batch, buckets, depth, True)
    return run


def _sent_likely(buckets: int, depth: int):
    """The whole names of all pages whose short ones repeat."""
    def run(frames: pa.Table, repeats: pa.Table) -> pa.Table:
        return pa.Table.from_batches(
            _sent(frames, buckets, depth, False, _names_of(repeats)[0]), pa.schema(
                [("_frame", pa.int64()), ("_bucket", pa.int64()), ("_copy", pa.bool_()),
                 ("_names", pa.binary()), ("_tags", pa.binary())]))
    return run


def _names_of(found: pa.Table) -> list[np.ndarray]:
    """Ascending short names that repeat, and whole names that don't though their short ones do."""
    rows = [(wrong.as_py(), unpacked(x.as_buffer())) for wrong, x in zip(found["_wrong"], found["_names"])]
    return [np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for w, x in rows if w is wrong)]))
            for wrong in (False, True)]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each bucket without it, from batches sorted by bucket."""
    own, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(batch[c].to_pylist() for c in (
                "_bucket", "_frame", "_copy", "_names", "_tags"))):
            if bucket != own and rows:
                yield rows
                rows = []
            own = bucket
            rows.append(row)
    if rows:
        yield rows


def _among(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    """True for names among the ascending known ones."""
    if not len(known):
        return np.zeros(len(names), dtype=bool)
    return known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names


def _compared(batches, wrong: bool):
    """Names on distinct pages, or on one page, for each frame that sent them."""
    for rows in _by_bucket(batches):
        names, tags, sent = [], [], []
        for n, (_, copy, data, told) in enumerate(rows, 1):
            own = unpacked(data)
            sent.append(own)
            names.append(own)
            if copy:
                tags.append(np.frombuffer(told, np.uint32).astype(np.uint64))
                continue
            bits = np.unpackbits(np.frombuffer(told, np.uint8), count=len(own))
            names.append(own[bits > 0])  # on a second page of the row
            tags += [np.full(len(x), k << 32, np.uint64) for k, x in enumerate(names[-2:], 2 * n)]
        values, least, most = _distinct_names(np.concatenate(names), np.concatenate(tags))
        repeats = values[least != most]
        found = [(row[0], own[_among(own, repeats) != wrong]) for row, own in zip(rows, sent)]
        found = [(frame, packed(own)) for frame, own in found if len(own)]
        yield pa.RecordBatch.from_arrays([
            pa.array([frame for frame, _ in found], pa.int64()),
            pa.array([wrong] * len(found), pa.bool_()),
            pa.array([data for _, data in found], pa.binary())], ["_frame", "_wrong", "_names"])


def _repeated_names(batches):
    """Short names on distinct pages."""
    return _compared(batches, False)


def _wrong_names(batches):
    """Whole names on one page."""
    return _compared(batches, True)


def _settled(schema: pa.Schema, depth: int):
    """Texts of the pages of a frame by the names that repeat, and the check by the markup."""
    def run(frames: pa.Table, repeats: pa.Table) -> pa.Table:
        if not len(frames):
            raise RuntimeError("the frames of pages changed while their names were compared")
        likely, wrong = _names_of(repeats)
        out = [schema.empty_table()]
        for data in frames["_pages"]:
            for chunk in _chunks(_pages(data.as_buffer()), CHUNK):
                keys = [*zip(chunk["_host"].to_pylist(), chunk["_html"].to_pylist())]
                pages = dict.fromkeys(keys)
                parsed = [blocks(p) if p else [] for _, p in pages]
                tokens, _, kind, start, counts, names, at = suffix_names(
                    parsed, [h for h, _ in pages], depth)
                shared = _among(names & SHORT, likely) & ~_among(names, wrong)
                marked = _covered(len(tokens), at[shared], depth)
                kept = kept_blocks(parsed, counts, _block_repeats(marked, kind, start))
                pages = dict(zip(pages, map(_joined, parsed, kept)))
                out.append(chunk.select(["page_id", "url"]).append_column(
                    "text", pa.array([pages[k] for k in keys], pa.string())).cast(schema))
        return pa.concat_tables(out)
    return run


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html",
              shard: int = SHARD, depth: int = DEPTH) -> DataFrame:
    """page_id, url, text of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        F.col(page).alias("_html"), url_host(F.col(url)).alias("_host"))
    chars = rows.agg(F.sum(F.length("_html").cast("long"))).first()[0] or 0  # one number
    buckets = max(1, -(-chars // shard))
    key = F.xxhash64("_host", "_html")
    copies = stage(rows.filter("_html <> ''").groupBy(key.alias("_key")).count().filter(
        "count > 1").select("_key", F.lit(True).alias("_copy")), "html-copies")
    parts = max(2 * buckets, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # or they move again
    frames = (
        rows.withColumn("_key", key).join(copies, "_key", "left").drop("_key")
        .mapInArrow(_framed, FRAMED).repartition(parts, "_frame"))

    def compared(names, how):
        return names.repartition(buckets, "_bucket").sortWithinPartitions("_bucket").mapInArrow(how, SHARED)

    def with_names(names, how, schema):
        return frames.groupBy("_frame").cogroup(names.groupBy("_frame")).applyInArrow(how, schema)

    likely = compared(frames.mapInArrow(_sent_short(buckets, depth), BUCKETED), _repeated_names)
    wrong = compared(with_names(likely, _sent_likely(buckets, depth), BUCKETED), _wrong_names)
    schema = StructType([StructField("page_id", rows.schema["page_id"].dataType),
                         StructField("url", StringType()), StructField("text", StringType())])
    return with_names(likely.unionByName(wrong), _settled(to_arrow_schema(schema), depth), schema)


def op13_html_main_text(spark, sf_dir: str) -> DataFrame:
    """Every page: its main text and the number of its code points."""
    return main_text(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long"))
