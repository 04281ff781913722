"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Every text (one space put before it) is encoded by a byte-level BPE (A) and by a
byte-fallback BPE (B).  Byte offsets where tokens of both end cut the text into
groups; all A-B pairs inside a group are *links*.  A pair of ids counts the
documents that hold it linked, over the whole corpus.

External spill counting, with Spark's shuffles as the spill:

1. ``encode`` tokenises chunks of whole documents (about ``CHUNK`` bytes) and sorts
   each chunk's (A id, B id, document, times) records, A first.  They are dealt by
   radix (the low bits of the A id) into zstd *runs*: ``heads`` (pairs and their
   numbers of documents, in frames) and ``body`` (documents and times).  Written
   once to the shared folder, nothing is tokenised twice.
2. ``count`` reads the heads only.  A radix with many bytes is salted, so a hot A id
   (a space, a comma) is many tasks of about ``GROUP`` bytes; each merges its runs
   with a heap over their frames and adds up equal pairs.
3. ``finish`` merges the salts of each radix (now distinct pairs only).  The order is
   A-major, so an id's maximum is known as soon as its pairs have streamed by.
4. ``give_back`` sends each radix its table and streams the runs by it; a run gives
   one blob (links at the maximum, sum of counts) for its chunk's documents.
5. ``combine`` adds the blobs of each chunk to its digests.

A chunk's documents stand in no other chunk, so a run's numbers of documents add up.
Memory: a chunk's tokens, one group's compressed heads, one radix's table of distinct
pairs (at most ids(A) x ids(B) / radixes rows, whatever the corpus).

Defined results: null or empty texts and texts that an encoder does not give back
byte for byte (U+2581 stands for a space in B) have no tokens, all zeros and an empty
``groups_sha256``.  Rows that repeat a document count as documents of their own; null
``doc_id`` stays null.  Extra columns are dropped.  Invalid UTF-8 has no tokens.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import io
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.text import chunks, id_and_text, map_arrow, stash

#: Where the vocabulary files lie, and their names.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK, GROUP, FRAME, RADIXES = 2 << 20, 64 << 20, 1 << 14, 64
#: Pairs of a group beyond which equal tokens of the group are added up first.
WIDE = 1 << 12
#: A pair is A << B_BITS | B; a record is pair << DOC_BITS | document of the chunk.
B_BITS, DOC_BITS = 20, 20
STORED = "kind int, chunk long, radix int, heads binary, body binary"
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")

# fixed values: the pre-tokenizer's pattern of the byte-level vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A word of B with the spaces before it: no piece has a space after another character.
WORD = r" *[^ ]+| +"
#: Other than Latin letters: left to the vocabularies' own libraries.
OTHER = re.compile(r"[^\x00-ɏ]")


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for
    the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Vocabularies:
    """Both tokenizers with the bytes of every id.

    Texts of Latin letters take a quicker way to the same ids (``tests/llm`` hold them
    together).  A: its ids stand in the order of its merges, so ranks say what merges
    say.  B merges characters by score and never across a word's start: ranks in the
    order bytes, characters, pieces by score give the same merges when no character has
    more than two bytes."""

    def __init__(self, file_a: bytes, file_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole_a = Tokenizer.from_str(file_a.decode())
        self.whole_a.encode_special_tokens = True
        model = json.loads(file_a)["model"]
        back = byte_of_char()
        special = {t["id"] for t in json.loads(file_a)["added_tokens"]}
        self.a = [b""] * (max([*model["vocab"].values(), *special]) + 1)
        for piece, i in model["vocab"].items():
            if i not in special:
                self.a[i] = bytes(back[c] for c in piece)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = all(model["vocab"]["".join(m)] == 256 + i for i, m in enumerate(merges))
        ranks = {b: i for i, b in enumerate(self.a) if b and i not in special}

        self.whole_b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        sp = self.whole_b
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i)
                  else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        plain = [i for i, x in enumerate(self.b) if x and not sp.is_byte(i)]
        single = {self.b[i]: i for i in range(len(names)) if sp.is_byte(i)} | {self.b[i]: i for i in plain if len(self.b[i]) == 1}
        chars = [i for i in plain if len(names[i]) == 1 and len(self.b[i]) > 1]
        longer = sorted((i for i in plain if len(names[i]) > 1), key=sp.get_score, reverse=True)
        order = [single[bytes([x])] for x in range(256) if bytes([x]) in single] + chars + longer
        by_word = (len(single) == 256 and len({sp.get_score(i) for i in longer if names[i][:2] != "▁▁"}) == sum(names[i][:2] != "▁▁" for i in longer)
                   and not any("▁" in n.lstrip("▁") for n in names))
        self.id_of_rank = np.array(order, np.int64)
        self.quick = in_order and by_word and (
            tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}),
            tiktoken.Encoding("b", pat_str=WORD, mergeable_ranks={self.b[i]: r for r, i in enumerate(order)}, special_tokens={}))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and the text by A and B; None if either does not give the bytes back."""
        spaced = " " + text
        # two spaces together: B's pieces of spaces have equal scores
        if self.quick and not (text[0] == " " or "  " in text or OTHER.search(text)):  # nothing is lost: both cut the text
            return (self.quick[0].encode_to_numpy(spaced, disallowed_special=()).astype(np.int64),
                    self.id_of_rank[self.quick[1].encode_to_numpy(spaced, disallowed_special=())])
        a = self.whole_a.encode(spaced, add_special_tokens=False).ids
        b = self.whole_b.encode(text)
        want = spaced.encode()
        if b"".join([self.a[i] for i in a]) != want or b"".join([self.b[i] for i in b]) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


_LOADED: dict = {}


def vocabularies(files) -> Vocabularies:
    """One copy a worker."""
    if files.id not in _LOADED:
        _LOADED.clear()
        _LOADED[files.id] = Vocabularies(*files.value)
    return _LOADED[files.id]


# ---------------------------------------------------------------- runs


@functools.cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers as one zstd frame, each array in the narrowest type."""
    out = io.BytesIO()
    for a in arrays:
        kind = np.min_scalar_type(int(a.max()) if len(a) else 0)
        out.write(struct.pack("<cq", kind.char.encode(), len(a)))
        # bytes of equal weight side by side compress better
        out.write(np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(len(a), kind.itemsize).T).tobytes())
    return _zstd()[0].compress(out.getvalue())


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = _zstd()[1].decompress(blob), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<cq", data, at)
        kind, at = np.dtype(kind.decode()), at + 9
        part = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(-1).astype(np.int64))
        at += n * kind.itemsize
    return out


def pack_run(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted pairs and their counts in frames of ``FRAME`` pairs."""
    frames = [pack(np.diff(pairs[i:i + FRAME], prepend=0), counts[i:i + FRAME]) for i in range(0, len(pairs), FRAME)]
    return struct.pack(f"<q{len(frames)}q", len(frames), *map(len, frames)) + b"".join(frames)


def frames_of(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A run's frames, one at a time."""
    n = struct.unpack_from("<q", run)[0]
    at = 8 * (n + 1)
    for size in struct.unpack_from(f"<{n}q", run, 8):
        steps, counts = unpack(run[at:at + size])
        yield np.cumsum(steps), counts
        at += size


def merge(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the sorted distinct pairs of all runs with their counts added up.

    The heap holds the last pair of each run's open frame; up to the least of these
    every run's part is at hand, so equal pairs meet in one block."""
    heap, open_, streams = [], {}, {i: frames_of(r) for i, r in enumerate(runs)}

    def advance(i: int) -> None:
        frame = next(streams[i], None)
        if frame is None:
            del streams[i]
            open_.pop(i, None)
        else:
            open_[i] = frame
            heapq.heappush(heap, (int(frame[0][-1]), i))

    for i in list(streams):
        advance(i)
    while heap:
        bound, ended = heap[0][0], []
        while heap and heap[0][0] == bound:
            ended.append(heapq.heappop(heap)[1])
        keys, sums = [], []
        for i, (k, c) in open_.items():
            if k[0] <= bound:
                n = int(np.searchsorted(k, bound, "right"))
                keys.append(k[:n])
                sums.append(c[:n])
                if n < len(k):
                    open_[i] = (k[n:], c[n:])
        for i in ended:
            advance(i)
        k, c = np.concatenate(keys), np.concatenate(sums)
        if len(keys) > 1:
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            start = np.flatnonzero(np.diff(k, prepend=-1))
            k, c = k[start], np.add.reduceat(c, start)
        yield k, c


# ---------------------------------------------------------------- 1: encode


def tables(v: Vocabularies) -> tuple:
    """Byte lengths of the ids, and their digits followed by each separator."""
    digits = [[f"{i}{sep}" for i in range(len(side))] for side, seps in ((v.a, ",|"), (v.b, ",;")) for sep in seps]
    return (np.array([len(x) for x in v.a], np.int64), np.array([len(x) for x in v.b], np.int64),
            [s for d in digits for s in d])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], +1, ... (sizes[0] times), starts[1], ...``."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def align(v: Vocabularies, tab: tuple, texts: list[bytes | None]):
    """Digests of a chunk (tokens, groups, links, hash of each text) and its records:
    sorted ``pair << DOC_BITS | document`` with the number of links of each."""
    len_a, len_b, digits = tab
    n = len(texts)
    n_a, n_b, n_groups, n_links = (np.zeros(n, np.int64) for _ in range(4))
    sha = [""] * n
    docs, ids_a, ids_b = [], [], []
    for i, t in enumerate(texts):
        try:
            ids = v.encode(t.decode()) if t else None
        except UnicodeDecodeError:
            ids = None
        if ids is not None:
            docs.append(i)
            ids_a.append(ids[0])
            ids_b.append(ids[1])
    if not docs:
        return (n_a, n_b, n_groups, n_links, sha), np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.array(docs)
    n_a[rows], n_b[rows] = list(map(len, ids_a)), list(map(len, ids_b))
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    del ids_a, ids_b
    end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    text_end = np.cumsum([len(texts[d]) + 1 for d in docs])
    ends = np.zeros(int(text_end[-1]) + 1, np.uint8)
    ends[end_a] = 1
    ends[end_b] += 2
    both = ends == 3  # each text's end is one of them
    last_a, last_b = np.flatnonzero(both[end_a]) + 1, np.flatnonzero(both[end_b]) + 1
    first_a, first_b = np.r_[0, last_a[:-1]], np.r_[0, last_b[:-1]]
    size_a, size_b = last_a - first_a, last_b - first_b
    n_groups[rows] = np.diff(np.searchsorted(end_a[last_a - 1], text_end, "right"), prepend=0)
    group_doc = np.repeat(rows, n_groups[rows])
    np.add.at(n_links, group_doc, size_a * size_b)

    # digits of the groups: A's tokens then B's, the last of each with the other separator
    name = np.empty(len(a) + len(b), np.int64)
    at_a = np.arange(len(a)) + np.repeat(first_b, size_a)
    side = np.ones(len(name), bool)
    side[at_a] = False
    name[at_a], name[side] = a, b + 2 * len(v.a)
    name[last_a - 1 + first_b] += len(v.a)
    name[last_b - 1 + last_a] += len(v.b)
    stop = np.cumsum(n_a[rows] + n_b[rows])
    for d, lo, hi in zip(docs, np.r_[0, stop[:-1]].tolist(), stop.tolist()):
        sha[d] = hashlib.sha256("".join([digits[i] for i in name[lo:hi].tolist()])[:-1].encode()).hexdigest()

    one = (size_a == 1) & (size_b == 1)
    wide = size_a * size_b > WIDE
    slim = np.flatnonzero(~one & ~wide)
    left = spread(first_a[slim], size_a[slim])
    fan = np.repeat(size_b[slim], size_a[slim])
    right = spread(np.repeat(first_b[slim], size_a[slim]), fan)
    doc = np.repeat(np.repeat(group_doc[slim], size_a[slim]), fan)
    keys = np.concatenate([((a[first_a[one]] << B_BITS | b[first_b[one]]) << DOC_BITS) | group_doc[one],
                           ((np.repeat(a[left], fan) << B_BITS | b[right]) << DOC_BITS) | doc])
    times = None
    if wide.any():
        more, many = [], []
        for g in np.flatnonzero(wide):
            ua, ca = np.unique(a[first_a[g]:last_a[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g]:last_b[g]], return_counts=True)
            more.append((((ua[:, None] << B_BITS) | ub) << DOC_BITS | group_doc[g]).ravel())
            many.append((ca[:, None] * cb).ravel())
        times = np.concatenate([np.ones(len(keys), np.int64), *many])
        keys = np.concatenate([keys, *more])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    else:
        keys.sort()
    start = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.add.reduceat(times, start) if times is not None else np.diff(np.r_[start, len(keys)])
    return (n_a, n_b, n_groups, n_links, sha), keys[start], times


def to_runs(keys: np.ndarray, times: np.ndarray, radixes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """The chunk's records as one run a radix."""
    radix = ((keys >> (B_BITS + DOC_BITS)) & (radixes - 1)).astype(np.uint16)
    order = np.argsort(radix, kind="stable")
    keys, times, radix = keys[order], times[order], radix[order]
    bounds = np.searchsorted(radix, np.arange(radixes + 1))
    for r in range(radixes):
        lo, hi = int(bounds[r]), int(bounds[r + 1])
        if lo == hi:
            continue
        pairs, docs = keys[lo:hi] >> DOC_BITS, keys[lo:hi] & ((1 << DOC_BITS) - 1)
        start = np.flatnonzero(np.diff(pairs, prepend=-1))
        steps = np.diff(docs, prepend=0)
        steps[start] = docs[start]  # a pair's documents ascend
        yield r, pack_run(pairs[start], np.diff(np.r_[start, hi - lo])), pack(steps, times[lo:hi])


def encode(files, radixes: int):
    def fn(batches):
        v = vocabularies(files)
        tab = tables(v)
        part, serial = TaskContext.get().partitionId() << 32, 0
        for batch in chunks(batches, CHUNK):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            digest, keys, times = align(v, tab, texts)
            n_a, n_b, n_groups, n_links, sha = digest
            sink = pa.BufferOutputStream()
            table = pa.RecordBatch.from_arrays([ids, *map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(sha, pa.string())],
                                               names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_batch(table)
            out = [(0, part + serial, None, None, sink.getvalue().to_pybytes())]
            out += [(1, part + serial, r, heads, body) for r, heads, body in to_runs(keys, times, radixes)]
            serial += 1
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                names=["kind", "chunk", "radix", "heads", "body"])

    return fn


# ---------------------------------------------------------------- 2 to 5


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}


def by(rows: Iterator[dict], *names: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Neighbouring rows of equal key; each group is read as it comes."""
    import itertools

    return itertools.groupby(rows, key=lambda r: tuple(r[n] for n in names))


def blobs(rows: list[tuple], **types) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values())], names=list(types))


def joined_run(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[bytes]:
    """Merged blocks as runs of about a million pairs."""
    held, n = [], 0
    for block in blocks:
        held.append(block)
        n += len(block[0])
        if n >= 1 << 20:
            yield pack_run(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield pack_run(*map(np.concatenate, zip(*held)))


def count(batches):
    """Heads of one radix and salt -> their distinct pairs with numbers of documents."""
    for (radix, _), rows in by(rows_of(batches), "radix", "salt"):
        for run in joined_run(merge([r["heads"] for r in rows])):
            yield blobs([(radix, run)], radix=pa.int32(), run=pa.binary())


def whole_ids(blocks):
    """The same blocks, cut between A ids."""
    held = None
    for k, c in blocks:
        if held is not None:
            k, c = np.concatenate([held[0], k]), np.concatenate([held[1], c])
        at = int(np.searchsorted(k, k[-1] >> B_BITS << B_BITS))
        held = (k[at:], c[at:])
        if at:
            yield k[:at], c[:at]
    if held is not None:
        yield held


def finish(batches):
    """Partial counts of one radix -> pairs, counts, and whether a count is the
    highest of its A id."""
    for (radix,), rows in by(rows_of(batches), "radix"):
        for seq, (k, c) in enumerate(whole_ids(merge([r["run"] for r in rows]))):
            start = np.flatnonzero(np.diff(k >> B_BITS, prepend=-1))
            top = np.repeat(np.maximum.reduceat(c, start), np.diff(np.r_[start, len(k)]))
            yield blobs([(radix, seq, pack(np.diff(k, prepend=0), c, (c == top).astype(np.int64)))],
                        radix=pa.int32(), seq=pa.int64(), run=pa.binary())


def give_back(batches):
    """A radix's table, then its runs: each run's shares for its chunk's documents."""
    for _, rows in by(rows_of(batches), "radix", "salt"):
        parts, table = [], None
        for r in rows:
            if r["kind"] == 0:
                steps, c, top = unpack(r["heads"])
                parts.append((np.cumsum(steps), c, top))
                continue
            if table is None:
                table, parts = [np.concatenate(x) for x in zip(*parts)], []
            pairs, sizes = (np.concatenate(x) for x in zip(*frames_of(r["heads"])))
            steps, times = unpack(r["body"])
            # documents ascend inside a pair: undo the steps pair by pair
            total = np.cumsum(steps)
            start = np.cumsum(sizes) - sizes
            docs = total - np.repeat(total[start] - steps[start], sizes)
            at = np.repeat(np.searchsorted(table[0], pairs), sizes)
            n = int(docs.max()) + 1
            best, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(best, docs, times * table[2][at])
            np.add.at(sums, docs, times * table[1][at])
            yield blobs([(r["chunk"], pack(best, sums))], chunk=pa.int64(), body=pa.binary())


def combine(batches):
    """A chunk's digests, then its shares."""
    for _, rows in by(rows_of(batches), "chunk"):
        table = best = sums = None
        for r in rows:
            if r["kind"] == 0:
                table = pa.ipc.open_stream(r["body"]).read_next_batch()
                best, sums = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
            else:
                b, s = unpack(r["body"])
                best[:len(b)] += b
                sums[:len(s)] += s
        *front, sha = table.columns
        yield pa.RecordBatch.from_arrays([*front, pa.array(best), pa.array(sums), sha],
                                         names=[x.split()[0] for x in RESULT.split(", ")])


def cross_tokenizer_alignment(docs: DataFrame, folder: str = FOLDER, radixes: int = RADIXES,
                              group_bytes: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """``(per document, per pair)``: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256`` of every row, and ``a, b, documents, is_best`` of every
    linked pair of ids.

    ``radixes`` (a power of two) bounds a table: each holds 1 / radixes of the pairs."""
    spark = docs.sparkSession
    raw = []
    for name in (FILE_A, FILE_B):
        with open(os.path.join(folder, name), "rb") as f:
            raw.append(f.read())
    files = spark.sparkContext.broadcast(tuple(raw))  # two vocabulary files, about 2 MB
    stored = stash(map_arrow(id_and_text(docs), encode(_Files(files), radixes), STORED), "runs")
    runs = stored.where("kind = 1")
    sizes = runs.groupBy("radix").agg(F.sum(F.octet_length("heads") + F.octet_length("body")).alias("n")).collect()
    salts = {r["radix"]: -(-r["n"] // group_bytes) for r in sizes}  # one number a radix
    groups = max(1, sum(salts.values()))
    parts = max(min(groups, 512), groups // 16)
    wide = F.element_at(F.create_map(*[F.lit(int(x)) for kv in (salts or {0: 1}).items() for x in kv]), F.col("radix"))
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("chunk"), wide).cast("int"))

    def sorted_by(df: DataFrame, keys: list[str], *then: str) -> DataFrame:
        return df.repartition(parts, *keys).sortWithinPartitions(*keys, *then)

    partial = map_arrow(sorted_by(salted.select("radix", "salt", "heads"), ["radix", "salt"]), count, "radix int, run binary")
    table = stash(map_arrow(sorted_by(partial, ["radix"]), finish, "radix int, seq long, run binary"), "pairs")
    none = F.lit(None).cast("binary")
    lent = table.withColumn("salt", F.explode(F.sequence(F.lit(0), wide.cast("int") - 1))).select(
        "radix", "salt", F.lit(0).alias("kind"), F.col("seq").alias("chunk"), F.col("run").alias("heads"), none.alias("body"))
    both = lent.unionByName(salted.select("radix", "salt", "kind", "chunk", "heads", "body"))
    shares = map_arrow(sorted_by(both, ["radix", "salt"], "kind", "chunk"), give_back, "chunk long, body binary")
    digests = stored.where("kind = 0").select("chunk", "kind", "body")
    ready = sorted_by(digests.unionByName(shares.select("chunk", F.lit(1).alias("kind"), "body")), ["chunk"], "kind")
    pairs = map_arrow(table.select("run"), list_pairs, "a int, b int, documents long, is_best boolean")
    return map_arrow(ready, combine, RESULT), pairs


class _Files:
    """The broadcast files under a name that tells one call's from another's."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, os.urandom(8).hex()

    @property
    def value(self):
        return self.broadcast.value


def list_pairs(batches):
    for r in rows_of(batches):
        steps, c, top = unpack(r["run"])
        k = np.cumsum(steps)
        yield pa.RecordBatch.from_arrays(
            [pa.array((k >> B_BITS).astype(np.int32)), pa.array((k & ((1 << B_BITS) - 1)).astype(np.int32)), pa.array(c),
             pa.array(top.astype(bool))], names=["a", "b", "documents", "is_best"])
