"""Main text of web pages by the runs of tokens that the pages of a host share.

Every run of 2^DOUBLINGS tokens is hashed with its host. Batches of pages send their distinct hashes to buckets, ranges of the
hash; a bucket counts the pages of each and answers one bit a hash. First only the leading bits of the hashes are sent, then the
whole hashes of the few whose leading bits several pages have: few runs repeat, and the answer is that of the whole hashes. So a run is found on however many pages and in however large
a host it repeats, and a common one costs a row a batch. Runs on distinct pages are boilerplate; unique runs stay. Landmarks of
the page complete this: what lies in menus, forms, footers and the like goes even where no other page repeats it. Within an
article, a block goes if all of it repeats on several pages that are mostly their own, so that mirrors do not delete each other.
"""

from __future__ import annotations

import json
import re
import struct
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from . import kernels as K
from .shared import kept

# Doubling steps: runs of 2^3 tokens and more count as long.
DOUBLINGS = 3
WIDTH = 1 << DOUBLINGS
# Bytes of pages in a batch and hashes in a bucket: both bound a task's memory and decide no result.
SHARD_BYTES = 8 << 20
BUCKET_KEYS = 1 << 20
# Leading bits of a hash that are sent first: at least so many, and so many more than number the tokens. They decide no result.
PRINT_BITS, SPARE_BITS = 36, 6
# Blocks of an article go if they repeat on so many articles of which this part repeats at most: two may quote one another.
ARTICLE_PAGES, ARTICLE_PART = 3, 0.25

BOILERPLATE, ARTICLE, OPEN = 0, 1, 2
# Elements of the HTML standard by what they are for.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|audio|video"
LANDMARKS = frozenset("head nav header footer aside form menu dialog button fieldset".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
                    "strong sub sup time tt u var wbr").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# Elements whose content is text that nothing but their own end tag ends, as in the HTML standard.
RAWTEXT = frozenset("script style textarea iframe noscript".split())
SKIPPED = frozenset(RAW.split("|"))
# One forward pass: no pattern is tried twice over the same characters, as every repetition is possessive.
_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|!--|[!?/])")
_INSIDE = re.compile(r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+)>")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"?|'[^']*+'?|[^\s>\"'][^\s>]*+)?+)?+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in SKIPPED}


def markup(source: str):
    """(text before, closing, name, attributes, text after the last) of every tag in one pass over a page, by the rules of the HTML standard.

    Comments, declarations and elements that hold no prose are a space in the text. A tag, comment or raw text that the page ends in is
    dropped with what it holds; other elements that hold no prose are left out only as far as they are closed.
    """
    at, text, unclosed = 0, [], set()
    while m := _MARKUP.search(source, at):
        text.append(source[at:m.start()])
        if m[2] is None:
            text.append(" ")
            if m[0] == "<!--":
                empty = next((e for e in ("<!-->", "<!--->") if source.startswith(e, m.start())), "")
                end = source.find("-->", m.end())
                bang = source.find("--!>", m.end(), end if end >= 0 else len(source))
                at = m.start() + len(empty) if empty else bang + 4 if bang >= 0 else end + 3 if end >= 0 else len(source)
            else:
                at = source.find(">", m.end()) + 1 or len(source)
            continue
        inside = _INSIDE.match(source, m.end())
        if inside is None:
            at = len(source)
            break
        at, name = inside.end(), m[2].lower()
        if name in SKIPPED:
            text.append(" ")
            if not m[1] and not inside[1].endswith("/") and name not in unclosed:
                end = _END[name].search(source, at)
                close = _INSIDE.match(source, end.end()) if end else None
                if close:
                    at = close.end()
                elif name in RAWTEXT:
                    at = len(source)
                else:
                    unclosed.add(name)
            continue
        yield "".join(text), bool(m[1]), name, inside[1]
        text.clear()
    yield "".join([*text, source[at:]]), False, "", ""


def names_of(attributes: str) -> tuple[list[str], list[str]]:
    """The values of class, role, aria-label and hidden, and those of id, of a tag."""
    said, ids = [], []
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "role", "aria-label", "hidden", "id"):
            (ids if name == "id" else said).append(unescape(value.strip(value[0]) if value[:1] in ("'", '"') else value))
    return said, ids


_WORDS = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|adsense|adslot|banner|breadcrumbs?|comments?|disqus|respond|cookies?|consent|gdpr|notice|notification|promo\w*|"
    r"sponsor\w*|sidebar|menu|nav|navbar|navigation|navigational|footer|header|masthead|contentinfo|complementary|search|social|share|sharing|related|"
    r"recommended|newsletter|subscribe|signup|login|popup|modal|overlay|widget|toolbar|pagination|pager|tags|copyright|skip\w*)(?![a-z])", re.I)


# Reader comments go whatever they hold; other names may sit on a wrapper.
_COMMENTS = re.compile(r"(?<![a-z])(?:comments?|disqus|respond|repl(?:y|ies))(?![a-z])", re.I)
# What a name says of the layout or the state of an element, not of its purpose.
_STATE = re.compile(r"(?<![a-z])(?:has|with|without|no|is|not)[-_][\w-]+|[\w-]+[-_](?:open|closed|enabled|disabled|count|layout)(?![\w-])", re.I)
# Open elements that a start tag ends, as far as one of the same list, table or choice is open.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select article main".split())
CONTENT = frozenset(("article", "main"))
STAYS, UNCLOSED, DROPPED = 0, 1, 2


# An id names its element's purpose if all its parts do, with these; otherwise it is a slug of what the element is about.
_LAYOUT = frozenset(("list area box wrap wrapper container section block main top bottom left right site page global primary secondary inner outer "
                     "content form bar panel region links items post article entry user reader blog div").split())
# Headings and prose are named after their subject.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd td th tr table figure figcaption".split())


def purpose(ident: str) -> str:
    """An id as a name of a purpose, or nothing."""
    parts = [x for x in re.split(r"[-_:.\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", ident)) if x]
    return " ".join(parts) if all(x.lower() in _LAYOUT or _WORDS.fullmatch(x) or _COMMENTS.fullmatch(x) for x in parts) else ""


class _Element:
    __slots__ = ("parent", "name", "comment", "named", "closed", "words", "wraps", "state", "content")

    def __init__(self, parent: "_Element | None", name: str, attributes: str):
        said, ids = names_of(attributes) if attributes and name not in ("html", "body", "main") else ([], [])
        values = [_STATE.sub(" ", v) for v in said] + [purpose(v) for v in ids if name not in PROSE]
        self.parent, self.name, self.closed, self.words, self.wraps = parent, name, False, 0, False
        if parent is not None:
            parent.wraps = True
        self.comment = any(_COMMENTS.search(v) for v in values)
        self.named = name not in CONTENT and any(_WORDS.search(v) for v in values)

    def resolve(self, wrapper: bool) -> None:
        """Sets `state` and `content`; the parent has them. What is never closed ends at the next article, as if it had been."""
        above = self.parent.state if self.parent else STAYS
        if above == UNCLOSED and self.name in CONTENT:
            above = STAYS
        drops = self.comment or self.name in LANDMARKS and self.name != "form" or (self.named or self.name == "form") and not wrapper
        self.state = max(above, STAYS if not drops else DROPPED if self.closed else UNCLOSED)
        self.content = not self.state and (self.name in CONTENT or self.parent is not None and self.parent.content)


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the non-empty blocks of a page in order; text has character references decoded and single spaces.

    A block is boilerplate if an element around it is: a landmark, a form, reader comments or something named like boilerplate.
    A form or a name counts for nothing on an element around others that holds most of the words outside links, nor does a name
    on body or main.
    """
    found, text, elements, stack = [], [], [], []
    linked, links = 0, 0  # open links, words inside links of this block

    def flush():
        nonlocal links
        joined = " ".join(unescape("".join(text)).split())
        text.clear()
        if joined:
            found.append((stack[-1] if stack else None, joined, max(0, joined.count(" ") + 1 - links)))
        links = 0

    def close(k: int):
        stack[k].closed = True
        del stack[k:]

    for before, closing, name, attributes in markup(html or ""):
        text.append(before)
        if linked:
            links += len(before.split())
        if name in INLINE:
            if name == "a":
                linked = 0 if closing else 1
            continue
        flush()
        if not name or name in VOID or attributes.endswith("/"):
            continue
        if stack and stack[-1].name == "p" and not (closing and name == "p"):
            close(len(stack) - 1)
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if stack[k].name in CONTENT and name not in ("body", "html", *CONTENT):
                    break  # a stray end tag does not end the article
            continue
        if name == "body" and any(e.name == "head" for e in stack):
            close(next(k for k, e in enumerate(stack) if e.name == "head"))
        for k in range(len(stack) - 1, -1, -1) if name in ENDED_BY else ():
            if stack[k].name in SCOPES:
                break
            if stack[k].name in ENDED_BY[name]:
                close(k)
                break
        stack.append(_Element(stack[-1] if stack else None, name, attributes))
        elements.append(stack[-1])
    for e in elements:
        e.resolve(True)  # every form and name taken for a wrapper
    for e, _, n in found:
        if e is not None and not e.state:
            e.words += n
    for e in reversed(elements):  # parents come before their children
        if e.parent is not None:
            e.parent.words += e.words
    total = sum(n for e, _, n in found if e is None or not e.state)
    for e in elements:
        e.resolve(e.wraps and 2 * e.words > total)
    return [(OPEN if e is None else BOILERPLATE if e.state else ARTICLE if e.content else OPEN, t) for e, t, _ in found]


class _Hashes(dict):
    """Hashes of words, each taken once."""

    def __missing__(self, word: str) -> int:
        self[word] = out = xxh3_64_intdigest(word.encode())
        return out


def squeezed(values: np.ndarray) -> bytes:
    """Sorted distinct values in about log2(their mean gap) + 2 bits each: low bits as they are, high bits in unary (after Elias and Fano)."""
    off, n = values - values[0], len(values)
    low = (int(off[-1]) // n).bit_length()
    bits = np.empty((n, low), np.uint8)
    for k in range(low):
        bits[:, k] = off >> np.uint64(k) & np.uint64(1)
    high = (off >> np.uint64(low)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1, np.uint8)
    unary[high] = 1
    return struct.pack("<QIB", int(values[0]), n, low) + np.packbits(bits).tobytes() + np.packbits(unary).tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    first, n, low = struct.unpack_from("<QIB", data)
    at, end = struct.calcsize("<QIB"), struct.calcsize("<QIB") + (n * low + 7) // 8
    out = (np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=end)))[:n] - np.arange(n)).astype(np.uint64) << np.uint64(low)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, end - at, at), count=n * low).reshape(n, low)
    for k in range(low):
        out |= bits[:, k].astype(np.uint64) << np.uint64(k)
    return out + np.uint64(first)


class Batch:
    """The pages of one row of `packed`, their tokens end to end, and the hash of every run of WIDTH tokens within a page."""

    def __init__(self, blob: bytes):
        self.pages = json.loads(zstandard.decompress(blob))
        found = [page[3] for page in self.pages]
        self.words = [[text.split(" ") for _, text in page] for page in found]
        flat = [w for page in self.words for block in page for w in block]
        self.inside = np.repeat([kind == ARTICLE for page in found for kind, _ in page], [len(b) for page in self.words for b in page]).astype(bool)
        self.page = np.repeat(np.arange(len(found)), [sum(map(len, page)) for page in self.words])
        hosts = K.hash_all([page[2].encode() for page in self.pages])
        runs = K.windows(np.fromiter(map(_Hashes().__getitem__, flat), np.uint64, len(flat)), WIDTH)
        last = len(runs)
        self.starts = np.flatnonzero(self.page[:last] == self.page[WIDTH - 1:]) if last else np.empty(0, np.int64)
        self.owner = self.page[self.starts]
        self.keys, self.key = np.unique(K.mixed(runs[self.starts] ^ K.mixed(hosts[self.owner])) if last else np.empty(0, np.uint64), return_inverse=True)

    def pages_of_keys(self, chosen: np.ndarray) -> np.ndarray:
        """For each of `keys`, on how many pages a `chosen` run has it; ARTICLE_PAGES stands for as many and more."""
        pairs = np.unique(self.key[chosen] * len(self.pages) + self.owner[chosen])
        return np.minimum(np.bincount(pairs // max(1, len(self.pages)), minlength=len(self.keys)), ARTICLE_PAGES).astype(np.uint8)

    def article_runs(self, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(runs that lie in an article and repeat, those of them on pages whose article is mostly its own)."""
        before = np.concatenate([[0], np.cumsum(self.inside)])
        runs = repeats & (before[self.starts + WIDTH] - before[self.starts] == WIDTH)
        n = len(self.pages)
        copied = np.bincount(self.page[self.covered(runs)], minlength=n)
        return runs, runs & (copied <= ARTICLE_PART * np.bincount(self.page[self.inside], minlength=n))[self.owner]

    def keys_of(self, runs: np.ndarray) -> np.ndarray:
        return np.bincount(self.key[runs], minlength=len(self.keys)) > 0

    def prints(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(the distinct values of the leading `bits` of `keys`, left in place, the first key of each)."""
        lead = self.keys >> np.uint64(64 - bits) << np.uint64(64 - bits)
        return np.unique(lead, return_index=True)

    def candidates(self, answers, buckets: int, bits: int) -> np.ndarray:
        """For each of `keys`, whether several pages may have it: whether they have its leading bits."""
        used, first = self.prints(bits)
        return np.repeat(self.receive(used, answers, buckets), np.diff(np.append(first, len(self.keys))))

    def repeats(self, maybe, seen, buckets: int, bits: int) -> np.ndarray:
        """For each run, whether several pages have it."""
        asked = self.candidates(maybe, buckets, bits)
        out = np.zeros(len(self.keys), bool)
        out[asked] = self.receive(self.keys[asked], seen, buckets)
        return out[self.key]

    def slices(self, used: np.ndarray, buckets: int) -> np.ndarray:
        """Where the hashes `used` of each bucket begin; buckets are ranges, so their hashes are neighbours."""
        bucket = (used >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))

    def send(self, ident: int, used: np.ndarray, counts: np.ndarray, buckets: int, bits: int = 64) -> pa.RecordBatch:
        cut, used = self.slices(used, buckets), used >> np.uint64(64 - bits)
        full = np.flatnonzero(cut[1:] > cut[:-1])
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(full), ident)), pa.array(full), pa.array([squeezed(used[cut[b]:cut[b + 1]]) for b in full], pa.binary()),
            pa.array([counts[cut[b]:cut[b + 1]].tobytes() for b in full], pa.binary())], ["batch", "bucket", "keys", "counts"])

    def receive(self, used: np.ndarray, answers, buckets: int) -> np.ndarray:
        """The buckets' bits, one for each of `used`."""
        out, cut = np.zeros(len(used), bool), self.slices(used, buckets)
        for a in answers or ():
            low, high = cut[a["bucket"]], cut[a["bucket"] + 1]
            out[low:high] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=high - low)
        return out

    def covered(self, repeats: np.ndarray) -> np.ndarray:
        """True for tokens inside a run that `repeats`, one flag for each run."""
        marks, starts = np.zeros(len(self.page) + 1, np.int64), self.starts[repeats]
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + WIDTH, -1)
        return np.cumsum(marks)[:-1] > 0


def _pack(shard_bytes: int):
    def run(batches):
        pages, size, tokens = [], 0, 0
        for batch in batches:
            for ident, url, host, html in zip(*(c.to_pylist() for c in batch.columns)):
                found = blocks(html)
                pages.append((ident, url, host, found))
                size += len(html or "")
                tokens += sum(text.count(" ") + 1 for _, text in found)
                if size >= shard_bytes:
                    yield _packed(pages, tokens)
                    pages, size, tokens = [], 0, 0
        if pages:
            yield _packed(pages, tokens)
    return run


def _packed(pages: list, tokens: int) -> pa.RecordBatch:
    blob = zstandard.compress(json.dumps(pages, ensure_ascii=False, separators=(",", ":")).encode(), 3)
    return pa.RecordBatch.from_arrays([pa.array([blob], pa.large_binary()).cast(pa.binary()), pa.array([tokens])], ["pages", "tokens"])


def _rows(batches):
    for batch in batches:
        for row in zip(*batch.columns):
            yield [v.as_py() for v in row]


def _prints(buckets: int, bits: int):
    def run(batches):
        for ident, blob in _rows(batches):
            b = Batch(blob)
            used, first = b.prints(bits)
            counts = b.pages_of_keys(np.ones(len(b.key), bool))
            counts = np.minimum(np.add.reduceat(counts, first, dtype=np.int64), ARTICLE_PAGES).astype(np.uint8) if len(first) else counts
            yield b.send(ident, used, counts, buckets, bits)
    return run


def _runs(buckets: int, bits: int):
    def run(batches):
        for ident, blob, maybe in _rows(batches):
            b = Batch(blob)
            asked = b.candidates(maybe, buckets, bits)
            yield b.send(ident, b.keys[asked], b.pages_of_keys(np.ones(len(b.key), bool))[asked], buckets)
    return run


def _article_runs(buckets: int, bits: int):
    def run(batches):
        for ident, blob, maybe, seen in _rows(batches):
            b = Batch(blob)
            runs, own = b.article_runs(b.repeats(maybe, seen, buckets, bits))
            asked = b.keys_of(runs)
            yield b.send(ident, b.keys[asked], b.pages_of_keys(own)[asked], buckets)
    return run


def judge(sent: pd.DataFrame, pages: int) -> pd.DataFrame:
    """For each batch of a bucket, one bit a hash: whether `pages` pages and more have it."""
    parts = [unsqueezed(k) for k in sent["keys"]]
    key = np.unique(np.concatenate(parts), return_inverse=True)[1]
    total = np.bincount(key, weights=np.concatenate([np.frombuffer(c, np.uint8) for c in sent["counts"]]))
    repeats = np.split((total >= pages)[key], np.cumsum([len(p) for p in parts])[:-1])
    return pd.DataFrame({"batch": sent["batch"].to_numpy(), "bucket": sent["bucket"].to_numpy(), "bits": [np.packbits(r).tobytes() for r in repeats]})


def _answered(sent: DataFrame, pages: int, name: str) -> DataFrame:
    """Per batch the answers of all buckets: one bit a distinct hash that the batch sent."""
    bits = sent.groupBy("bucket").applyInPandas(lambda rows: judge(rows, pages), "batch long, bucket long, bits binary")
    return bits.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


SENT = "batch long, bucket long, keys binary, counts binary"


def _texts(buckets: int, bits: int):
    def run(batches):
        for _, blob, maybe, seen, common in _rows(batches):
            b = Batch(blob)
            repeats = b.repeats(maybe, seen, buckets, bits)
            runs, _ = b.article_runs(repeats)
            asked, strips = b.keys_of(runs), np.zeros(len(b.keys), bool)
            strips[asked] = b.receive(b.keys[asked], common, buckets)
            covered, stripped = b.covered(repeats), b.covered(runs & strips[b.key])
            texts, repeated, at = [], [], 0
            for (*_, page), split in zip(b.pages, b.words):
                has_article = any(kind == ARTICLE for kind, _ in page)
                stay, n, strip = [], 0, []
                for (kind, text), block in zip(page, split):
                    hit, gone = covered[at:at + len(block)], stripped[at:at + len(block)].all()
                    at += len(block)
                    n += int(hit.sum())
                    if kind == ARTICLE:
                        (strip if gone else stay).append(text)
                    elif kind == OPEN and not has_article and not hit.all():
                        stay.append(" ".join(w for w, h in zip(block, hit) if not h))
                texts.append(" ".join(stay or strip))  # a page is never emptied
                repeated.append(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([p[0] for p in b.pages], pa.int64()), pa.array([p[1] for p in b.pages], pa.string()), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array(repeated, pa.int64())], ["page_id", "url", "text", "n_chars", "n_repeated"])
    return run


def extract(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of `pages`: page_id, url, `text`, `n_chars` and `n_repeated`, the page's tokens inside runs other pages repeat.

    Null and empty pages have an empty text. Pages without a host form one host. A task reads about `shard_bytes` of pages at
    a time, which decides no result. Rows that repeat a page are pages of their own; further columns are ignored; an empty
    table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    packed = rows.mapInArrow(_pack(shard_bytes), "pages binary, tokens long").withColumn("batch", F.monotonically_increasing_id())
    packed = kept(packed, "pages")
    tokens = packed.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(tokens // BUCKET_KEYS + 1, pages.sparkSession.sparkContext.defaultParallelism)
    bits = min(64, max(PRINT_BITS, tokens.bit_length() + SPARE_BITS))
    both = packed.select("batch", "pages")
    maybe = kept(_answered(both.mapInArrow(_prints(buckets, bits), SENT), 2, "maybe"), "prints")
    both = both.join(maybe, "batch", "left").select("batch", "pages", "maybe")
    seen = kept(_answered(both.mapInArrow(_runs(buckets, bits), SENT), 2, "seen"), "runs")
    both = both.join(seen, "batch", "left").select("batch", "pages", "maybe", "seen")
    common = kept(_answered(both.mapInArrow(_article_runs(buckets, bits), SENT), ARTICLE_PAGES, "common"), "strips")
    out = both.join(common, "batch", "left").select("batch", "pages", "maybe", "seen", "common").mapInArrow(
        _texts(buckets, bits), "page_id long, url string, text string, n_chars long, n_repeated long")
    return out.withColumnRenamed("page_id", ident).withColumnRenamed("url", url)
