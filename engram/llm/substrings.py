"""Repeated byte strings of L bytes, found with suffix sorting by a difference cover, one bucket at a time.

1. Texts are written once as blocks (files of the shared folder). In each block every window of L bytes is owned by an
   anchor, the K-gram in it with the smallest hash (leftmost of equals), so equal windows have equal anchors. Distinct
   anchors of a block go, packed by hash, to tasks that find those which several documents hold.
2. For the anchors that several documents hold, a block sends each distinct context (the bytes of the windows that an
   anchor owns) once, with the smallest doc_id that has it. A passage or text with very many copies thus costs one row
   per block, and no task gets all its copies.
3. A task has all contexts of its anchors. Their windows are the suffixes to sort, to depth L: the suffixes at places
   of a difference cover D modulo V are ranked first, with longest common prefixes; then buckets of suffixes, split by
   their leading bytes, are taken one at a time. Suffixes that tie on V leading bytes are resolved by the ranks of cover
   places: any two places have a shift d < V for which both shifted places are in the cover, so they agree on L bytes
   exactly if, for that d, their cover ranks lie in a run with common prefixes of L - d. The smallest doc_id of each
   class of equal windows comes back to the blocks as a bit mask per context.
4. Each block applies the masks and gives the removed runs and what is left of every text."""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import BIG_ID, cut, drop, filesystem, fresh_path, mixed

L, K = 50, 20
V, D = 7, (0, 1, 3)  # differences of D give all of 0..6 modulo 7
CHUNK = 1 << 19
BUCKET = 1 << 20
P = np.uint64(0x9E3779B97F4A7C15)


def _grams(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the K-grams (K = 20 = 16 + 4) that start at each byte."""
    h1 = b.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * P + h1[1:]
    h4 = mixed(h2[:-2] * P + h2[2:])
    h8 = h4[:-4] * P + h4[4:]
    h16 = h8[:-8] * P + h8[8:]
    return mixed(h16[: len(h4) - 16] * P + h4[16:])


def _owners(grams: np.ndarray) -> np.ndarray:
    """Place of the smallest gram among those of the window that starts at each byte; leftmost of equals."""
    x = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    w, n = 1, L - K + 1
    while 2 * w <= n:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    if w < n:
        x = np.minimum(x[: len(x) - (n - w)], x[n - w :])
    return (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchored(texts: list[bytes]):
    """Chunks of texts with their anchors: (number of the first text, ends of texts, bytes, anchor hash, text, first and last window)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size, j = size + len(texts[j]), j + 1
        raw = b"".join(texts[i:j])
        lens = np.array([len(t) for t in texts[i:j]], np.int64)
        ends = np.cumsum(lens)
        none = np.empty(0, np.int64)
        if len(raw) < L:
            yield i, ends, raw, np.empty(0, np.uint64), none, none, none
        else:
            grams = _grams(np.frombuffer(raw, np.uint8))
            own = _owners(grams)
            text = np.repeat(np.arange(j - i), lens)[: len(own)]
            at = np.flatnonzero(np.arange(len(own)) + L <= ends[text])
            o, t = own[at], text[at]
            new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (t[1:] != t[:-1])]) if len(at) else none
            last = at[np.r_[new[1:], len(at)] - 1] if len(at) else none
            yield i, ends, raw, grams[o[new]], t[new], at[new], last
        i = j


def _read_block(path: str):
    fs, at = filesystem(path)
    table = pq.read_table(at, filesystem=fs, columns=["doc_id", "text"])
    ids = table.column("doc_id")
    keys = np.array([BIG_ID if x is None else x for x in ids.to_pylist()], np.int64)
    return ids.combine_chunks() if ids.num_chunks != 1 else ids.chunk(0), keys, [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in table.column("text")]


def _read_side(folder: str, block: int, columns: list[str]):
    fs, at = filesystem(f"{folder}/block={block}")
    if fs.get_file_info(at).type.name != "Directory":
        return []
    return pads.dataset(at, filesystem=fs, format="parquet").to_table(columns=columns).to_pylist()


def _block_anchors(texts, keys):
    """Distinct anchors of a block, the sum of 1 or 2 for one or more documents."""
    parts_f, parts_d = [], []
    for i, _, _, f, t, _, _ in anchored(texts):
        parts_f.append(f)
        parts_d.append(keys[i + t])
    if not parts_f or not sum(map(len, parts_f)):
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    f, d = np.concatenate(parts_f), np.concatenate(parts_d)
    order = np.lexsort((d, f))
    f, d = f[order], d[order]
    head = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    tail = np.r_[head[1:], len(f)] - 1
    return f[head], (1 + (d[head] != d[tail])).astype(np.uint8)


def _block_contexts(texts, keys, held: np.ndarray):
    """Distinct contexts of the held anchors {bytes: number}, their smallest doc keys and anchors, and their uses (text, first window, number, windows)."""
    number: dict[bytes, int] = {}
    anchors, uses = array("Q"), []
    for i, ends, raw, f, t, first, last in anchored(texts):
        if not len(f) or not len(held):
            continue
        k = np.flatnonzero(held[np.minimum(np.searchsorted(held, f), len(held) - 1)] == f)
        f, t, first, last = f[k], t[k], first[k], last[k] + L
        known = len(number)
        nos = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(first.tolist(), last.tolist())], np.int32)
        new, at = np.unique(nos, return_index=True)
        anchors.frombytes(f[at[new >= known]].tobytes())
        lens = np.diff(ends, prepend=0)
        uses.append(np.stack([i + t, first - (ends[t] - lens[t]), nos, last - first - L + 1]))
    used = np.concatenate(uses, axis=1).astype(np.int32) if uses else np.empty((4, 0), np.int32)
    least = np.full(len(number), BIG_ID, np.int64)
    np.minimum.at(least, used[2], keys[used[0]])
    return number, least, np.frombuffer(anchors, np.uint64), used


def first_holders(contexts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For the windows of L bytes of all contexts in turn, the smallest doc key that has them."""
    lens = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts) + bytes(L + 16), np.uint8)
    starts = np.cumsum(lens) - lens
    counts = lens - L + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    offs = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[owner] + offs
    n = len(text) - 8
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | text[j : n + j]
    # ranks and longest common prefixes of the suffixes at cover places, to depth L
    wanted = np.zeros(n - L + V, bool)
    for d in range(V):
        wanted[at + d] = True
    cover = np.flatnonzero(wanted[: n - L] & np.isin(np.arange(n - L) % V, D))
    full, rest = divmod(L, 8)
    low = np.uint64((1 << 8 * (8 - rest)) - 1)
    keys = [word[cover + 8 * j] for j in range(full)] + [word[cover + 8 * full] & ~low]
    order = np.lexsort(keys[::-1])
    lcp, open_ = np.zeros(len(cover), np.int64), np.ones(max(0, len(cover) - 1), bool)
    for k in keys:
        k = k[order]
        x = k[1:] ^ k[:-1]
        same = sum((x >> np.uint64(56 - 8 * j) == 0).astype(np.int64) for j in range(8))
        lcp[1:] += np.where(open_, same, 0)
        open_ &= x == 0
    place_of = np.full(n - L + V, -1, np.int64)
    classes = np.empty((V, len(cover)), np.int32)
    for d in range(V):
        classes[d, order] = np.cumsum(lcp < L - d)
    place_of[cover] = np.arange(len(cover))
    best = docs[owner].copy()
    lead = word[at] >> np.uint64(8 * (8 - V))
    sorted_ = np.argsort(lead, kind="stable")
    heads = np.flatnonzero(np.r_[True, lead[sorted_][1:] != lead[sorted_][:-1]])
    group = np.empty(len(at), np.int64)
    group[sorted_] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(at)]))
    bounds = np.r_[heads, len(at)]
    cuts = np.unique(np.r_[0, bounds[np.searchsorted(bounds, np.arange(BUCKET, len(at), BUCKET))], len(at)])  # buckets of whole groups
    for lo, hi in zip(cuts, cuts[1:]):
        bucket = sorted_[lo:hi]
        for d in range(V):
            p = place_of[at[bucket] + d]
            mine, p = bucket[p >= 0], p[p >= 0]
            if not len(mine):
                continue
            key = (group[mine] << 32) | classes[d, p]
            o = np.argsort(key, kind="stable")
            run = np.flatnonzero(np.r_[True, key[o][1:] != key[o][:-1]])
            least = np.minimum.reduceat(docs[owner[mine]][o], run)
            best[mine[o]] = np.minimum(best[mine[o]], np.repeat(least, np.diff(np.r_[run, len(o)])))
    return best


def _packs(bucket: np.ndarray, n: int):
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    return ((h, order[ends[h] : ends[h + 1]]) for h in range(n) if ends[h] < ends[h + 1])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>"


def repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every row of docs(doc_id, text).

    Null text counts as empty. A byte goes if a window of L bytes that covers it also starts in a document with a smaller
    doc_id; rows with the same id don't remove each other, null ids come after all others and not among themselves."""
    spark = docs.sparkSession
    blocks_path = fresh_path(spark, "blocks")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").write.parquet(blocks_path)
    files = sorted(x for x in spark.read.schema("doc_id long, text string").parquet(blocks_path).inputFiles())
    if not files:
        return spark.createDataFrame([], RESULT)
    todo = spark.createDataFrame(list(enumerate(files)), "block long, path string").repartition(len(files), "block")
    buckets = 4 * max(8, len(files), int(spark.conf.get("spark.sql.shuffle.partitions")))  # grows with the input: a bucket's bytes don't
    each = lambda batches: ((b, p) for x in batches for b, p in zip(*(x.column(c).to_pylist() for c in ("block", "path"))))

    def anchors(batches):
        for block, path in each(batches):
            _, keys, texts = _read_block(path)
            f, many = _block_anchors(texts, keys)
            for h, at in _packs((f % np.uint64(buckets)).astype(np.int64), buckets):
                yield pa.RecordBatch.from_pylist([{"bucket": h, "block": block, "f": f[at].tobytes(), "many": many[at].tobytes()}], schema=SENT)

    SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("f", pa.binary()), ("many", pa.binary())])

    def held(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint64) for x in pdf["f"]]
        f, many = np.concatenate(parts), np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["many"]])
        order = np.argsort(f, kind="stable")
        head = np.flatnonzero(np.r_[True, f[order][1:] != f[order][:-1]])
        again = f[order][head][np.add.reduceat(many[order].astype(np.int64), head) > 1]
        return pd.DataFrame({"block": pdf["block"], "f": [np.intersect1d(p, again, assume_unique=True).tobytes() for p in parts]})

    def side(df: DataFrame, what: str) -> str:
        path = fresh_path(spark, what)
        df.repartition("block").sortWithinPartitions("block").write.partitionBy("block").parquet(path)
        return path

    held_path = side(todo.mapInArrow(anchors, "bucket long, block long, f binary, many binary").groupBy("bucket").applyInPandas(held, "block long, f binary"), "held")
    held_of = lambda block: np.sort(np.concatenate([np.frombuffer(r["f"], np.uint64) for r in _read_side(held_path, block, ["f"])] or [np.empty(0, np.uint64)]))

    def contexts(batches):
        for block, path in each(batches):
            _, keys, texts = _read_block(path)
            number, least, anchor, _ = _block_contexts(texts, keys, held_of(block))
            raws = list(number)
            for h, at in _packs((anchor % np.uint64(buckets)).astype(np.int64), buckets):
                row = {"bucket": h, "block": block, "no": at.astype(np.int32).tobytes(), "lens": np.array([len(raws[k]) for k in at], np.uint8).tobytes()}
                row |= {"docs": least[at].tobytes(), "raw": b"".join(raws[k] for k in at)}
                yield pa.RecordBatch.from_pylist([row], schema=SENT2)

    SENT2 = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("no", "lens", "docs", "raw"))])

    def masks(pdf: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        nos = []
        for lens, raw in zip(pdf["lens"], pdf["raw"]):
            ends = np.cumsum(np.frombuffer(lens, np.uint8), dtype=np.int64).tolist()
            nos.append(np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends], ends)], np.int64))
        keys = [np.frombuffer(x, np.int64) for x in pdf["docs"]]
        least = np.full(len(number), BIG_ID, np.int64)
        np.minimum.at(least, np.concatenate(nos), np.concatenate(keys))
        contexts = list(number)
        counts = np.array([len(c) - L + 1 for c in contexts], np.int64)
        smaller = first_holders(contexts, least) < np.repeat(least, counts)
        ends = np.cumsum(counts)
        place = np.arange(len(smaller)) - np.repeat(ends - counts, counts)
        bits = np.add.reduceat(np.where(smaller, np.uint64(1) << place.astype(np.uint64), np.uint64(0)), ends - counts)
        whole = (np.uint64(1) << counts.astype(np.uint64)) - np.uint64(1)
        full = [np.where(k > least[no], whole[no], bits[no]).astype(np.uint64).tobytes() for no, k in zip(nos, keys)]
        return pd.DataFrame({"block": pdf["block"], "no": pdf["no"], "mask": full})

    masks_path = side(todo.mapInArrow(contexts, "bucket long, block long, no binary, lens binary, docs binary, raw binary").groupBy("bucket").applyInPandas(masks, "block long, no binary, mask binary"), "masks")

    def apply(batches):
        for block, path in each(batches):
            ids, keys, texts = _read_block(path)
            number, least, _, (of, start, no, n) = _block_contexts(texts, keys, held_of(block))
            mask = np.zeros(len(number), np.uint64)
            for r in _read_side(masks_path, block, ["no", "mask"]):
                mask[np.frombuffer(r["no"], np.int32)] = np.frombuffer(r["mask"], np.uint64)
            del number
            full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
            got = np.where(keys[of] > least[no], full, mask[no])
            hit: dict[int, list[tuple[int, int, int]]] = {}
            for k in np.flatnonzero(got):
                hit.setdefault(int(of[k]), []).append((int(start[k]), int(got[k]), int(n[k])))
            out = []
            for x, raw in enumerate(texts):
                spans: list[list[int]] = []
                for start, got, m in sorted(hit.get(x, [])):
                    whole = got == (1 << m) - 1
                    for a, b in [(start, start + m - 1 + L)] if whole else [(start + o, start + o + L) for o in range(m) if got >> o & 1]:
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((ids[x].as_py(), len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
                if len(out) == 2000 or x == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)
                    out = []

    NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    done, _ = cut(todo.mapInArrow(apply, RESULT), "spans")
    drop(spark, blocks_path, held_path, masks_path)
    return done
