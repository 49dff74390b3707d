"""Document fingerprints from closed syncmers, and what an edit leaves of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 10  # code points of an anchor
S = 4  # code points of the inner substrings compared
KEPT = 64  # anchors of a fingerprint, those with the lowest hashes, at least,
DENSE = 1 << 26  # and all whose 32-bit hash is lower than this, one in 64: about one anchor in 224 code points of any text
DRIFT = 64  # code points by which the offsets of matching anchors may differ
PIECE = 65_536  # code points handled at once; longer texts are cut with K - 1 code points of overlap

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    return h ^ (h >> np.uint64(29))


def closed_syncmers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the K-mers whose least S-mer is their first or their last.

    Whether a K-mer is chosen depends on its own code points only.
    """
    n = len(codes) - K + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    codes = codes.astype(np.uint64)
    inner = np.zeros(len(codes) - S + 1, dtype=np.uint64)
    for j in range(S):
        inner = inner * _P + codes[j : len(codes) - S + 1 + j]
    inner = _mix(inner)
    least, width, want = inner, 1, K - S + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    at = np.flatnonzero((inner[:n] == least) | (inner[K - S : K - S + n] == least))
    # three S-mers cover the K-mer
    return at, _mix((inner[at] * _P + inner[at + S]) * _P + inner[at + K - S])


def _whole(text: str) -> np.ndarray:
    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
    return np.frombuffer(digest + b"\0\0\0\0", dtype=">u4").reshape(1, 2)


def _lowest(row: np.ndarray, code: np.ndarray, place: np.ndarray):
    """First place of each code of a row, and of those the KEPT lowest codes per row and all below DENSE."""
    order = np.lexsort((place, (row.astype(np.uint64) << np.uint64(32)) | code.astype(np.uint64)))
    row, code, place = row[order], code[order], place[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    row, code, place = row[first], code[first], place[first]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    low = (rank < KEPT) | (code < DENSE)
    return row[low], code[low], place[low]


def _portions(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    portion: list[tuple[int, int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - K + 1), PIECE):
            part = text[at : at + PIECE + K - 1]
            if portion and size + len(part) > PIECE:
                yield portion
                portion, size = [], 0
            portion.append((i, at, part))
            size += len(part)
    if portion:
        yield portion


def fingerprints(texts: list[str]) -> list[str]:
    """A fingerprint per text: the anchors with the lowest 32-bit hashes, as hash and place, 16 hex digits each.

    These are the KEPT lowest and all below DENSE, so the anchors kept of a passage
    do not become fewer as the text around it grows.
    A text without an anchor, such as one of fewer than K code points, has its
    own hash at place 0; an empty text has the empty fingerprint. Of an anchor
    that occurs again the first place counts.
    """
    rows, codes, places = [], [], []
    for portion in _portions(texts):
        letters = np.frombuffer("".join(p for _, _, p in portion).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.array([len(p) for _, _, p in portion])
        starts = np.cumsum(sizes) - sizes
        at, code = closed_syncmers(letters)
        part = np.searchsorted(starts, at, side="right") - 1
        inside = at + K <= (starts + sizes)[part]
        at, code, part = at[inside], code[inside], part[inside]
        row = np.array([i for i, _, _ in portion])[part]
        place = at - starts[part] + np.array([a for _, a, _ in portion])[part]
        kept = _lowest(row, (code >> np.uint64(32)).astype(np.uint32), place)
        for store, values in zip((rows, codes, places), kept):
            store.append(values)
    if not rows:
        return ["" for _ in texts]
    row, code, place = _lowest(np.concatenate(rows), np.concatenate(codes), np.concatenate(places))
    pairs = np.stack([code, place.astype(np.uint32)], axis=1).astype(">u4")
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        own = pairs[ends[i] : ends[i + 1]]
        out.append((own if len(own) else _whole(text)).tobytes().hex() if text else "")
    return out


def _complete(anchors: np.ndarray) -> int:
    """The hash up to which a fingerprint has all anchors of its text."""
    return max(int(anchors[-1, 0]), DENSE - 1) if len(anchors) >= KEPT else 1 << 32


def likeness(a: str, b: str) -> float:
    """Share of anchors (0 to 1) that two texts have in common at matching places, from their fingerprints.

    Of the anchors of both, up to the hash to which both fingerprints have all, those
    count that occur in both and whose offset lies in the DRIFT wide band with most of them; m of u of them give
    2 m / (u + m). Equal fingerprints give 1, an empty one beside another 0.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(f), dtype=">u4").reshape(-1, 2).astype(np.int64) for f in (a, b))
    union = np.union1d(x[:, 0], y[:, 0])
    union = union[union <= min(_complete(x), _complete(y))]
    if not len(union):
        return 0.0
    both, i, j = np.intersect1d(x[:, 0], y[:, 0], assume_unique=True, return_indices=True)
    shared = both <= union[-1]
    shift = np.sort((x[i, 1] - y[j, 1])[shared])
    if not len(shift):
        return 0.0
    matched = int((np.searchsorted(shift, shift + DRIFT, side="right") - np.arange(len(shift))).max())
    return 2 * matched / (len(union) + matched)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``, or all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
AT_ONCE = 2000
RANGE_ROWS = 5000  # documents of a range, on average


def _rows(ids: list, texts: list[str], following: list[str]) -> pd.DataFrame:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    own = fingerprints([*texts, following[-1]])
    after = fingerprints(changed)
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids, dtype="Int64"),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
            "fingerprint": own[:-1],
            "edited_fingerprint": after,
            "near_edited": [likeness(x, y) for x, y in zip(own, after)],
            "near_next": [likeness(x, y) for x, y in zip(own, own[1:])],
        }
    )


def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range, in order, each with its next; the first row lent by the next range ends it."""
    held: tuple | None = None
    for batch in batches:
        for at in range(0, len(batch), AT_ONCE):
            part = batch.iloc[at : at + AT_ONCE]
            lent = part["lent"].to_numpy(dtype=bool)
            ids = [None if null else int(i) for i, null in zip(part["order_id"], part["no_id"])]
            texts = part["text"].tolist()
            own = int(np.argmax(lent)) if lent.any() else len(texts)
            seen_ids, seen = ids[:own], texts[:own]
            if held is not None:
                seen_ids, seen = [held[0], *seen_ids], [held[1], *seen]
            if own < len(texts):
                if seen:
                    yield _rows(seen_ids, seen, [*seen[1:], texts[own]])
                for _ in batches:  # more rows like the one that was lent
                    pass
                return
            if len(seen) > 1:
                yield _rows(seen_ids[:-1], seen[:-1], seen[1:])
            held = (seen_ids[-1], seen[-1]) if seen else None


def fingerprint_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and how alike they are.

    Documents are taken by descending ``doc_id``; rows without ``doc_id`` come
    last, as if it were the lowest number, and rows that repeat one go by text. A
    row's edited text ends in the beginning of the next row's text, the last
    row's in that of the first; a single row is its own next. Null texts are
    empty. Other columns are not read. An empty table gives no rows.

    The ids alone are read first: they give ranges of about equal size and the
    highest id of each. Then every text moves once, to the task of its range, and
    the first document of a range is lent to the range before. So no window spans
    the table and nothing but range bounds passes through the driver.
    """
    lowest = -(2**63)
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("order_id"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // RANGE_ROWS))
    cuts = [i / parts for i in range(1, parts)] or [0.5]
    bounds = base.agg(F.percentile_approx("order_id", cuts, max(10_000, 20 * parts)).alias("b")).first()["b"]
    bounds = np.unique(np.array(bounds if bounds is not None else [], dtype=np.int64))

    def range_of(ids: np.ndarray) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, ids, side="left")

    @F.pandas_udf("int")
    def piece(ids: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids.to_numpy()).astype(np.int32))

    tops = {r["p"]: r["top"] for r in base.select(piece("order_id").alias("p"), "order_id").groupBy("p").agg(F.max("order_id").alias("top")).collect()}
    full = sorted(tops)
    before = {tops[p]: full[i - 1] for i, p in enumerate(full)}  # the highest id of a range is lent to the range before

    @F.pandas_udf("array<struct<part:int,lent:boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"part": int(p), "lent": False}, *([{"part": before[i], "lent": True}] if i in before else [])]
                for i, p in zip(ids.tolist(), range_of(ids.to_numpy()))
            ]
        )

    return (
        base.select("*", F.explode(places("order_id")).alias("to"))
        .select("order_id", "no_id", "text", "to.part", "to.lent")
        .repartitionById(len(bounds) + 1, F.col("part"))
        .sortWithinPartitions("lent", F.col("order_id").desc(), "text")
        .select("order_id", "no_id", "text", "lent")
        .mapInPandas(along, OUT)
    )


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_syncmers": op10_syncmers}
