"""Lines that nearly repeat, over all documents: one occurrence of every group stays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.components import connected
from nearfield.llm.frames import columns, free_name
from nearfield.session import cut_lineage

RADIUS = 20  # differing bits of two SimHashes; of lines with SIMILARITY nearly all are nearer
SIMILARITY = 0.8  # 1 - edits / letters of the longer line
KEYS, ROWS = 12, 3  # keys of a line, and least hashes of its letter runs that make up a key
RUNS = ((8, 40, 1 << 62), (4, 1, 80))  # (letters of a run, letters of a line from, to); lines half as long as another share a kind
TASK_ROWS = 100_000
BROADCAST_IDS = 2_000_000  # so many line ids or shards (below 100 MB) travel to the lines; more are joined
SHARD_ROWS = 2000  # lines of one key compared at once; a fuller key is cut into parts that are compared two by two
BUCKET_KEYS = 500_000  # keys, 16 bytes each with their line, among which equal ones are looked for at once

BINS = 64
PAIRS_AT_ONCE = 50_000
AT_ONCE = 512  # lines hashed at once
SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # white space besides blank and \n
ASCII_SPACES = SPACES[:8]
KEYED_AT_ONCE = 128  # lines whose letter runs, 300 KB in the middle, are hashed at once
ANCHOR, REACH = 8, 64  # letters that two lines must share again after an edit, and how far on they are looked for
TOGETHER = (64, 5000)  # letters of the longer line from, to, of pairs whose distances are found many at once
CELLS, LETTERS = 8192, 65_000  # numbers in a row of such pairs, 16 KB; code points from the second on are left to single pairs
FAR = 16_000  # no distance of such pairs; with all steps added it still fits 16 bits
WAITING = 20_000  # pairs that wait to be compared together
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ODD = [np.uint64(xxhash.xxh64_intdigest(f"line key {i}") | 1) for i in range(KEYS * ROWS)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * TURN
    return h ^ (h >> np.uint64(29))


def keyed_lines(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of normalised lines, and the place in ``lines`` that each belongs to; none for an empty one.

    Two lines share a key the more likely, the more letter runs they share: a key
    is ROWS least hashes of a line's runs, and an edit changes only the runs
    across it. Short lines have short runs, and those between both kinds of keys.
    """
    sizes = np.array([len(line) for line in lines], dtype=np.int64)
    places, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for run, low, high in RUNS:
        chosen = np.flatnonzero((sizes >= low) & (sizes <= high))
        gap = "\0" * (run - 1)
        for at in range(0, len(chosen), KEYED_AT_ONCE):
            own = chosen[at : at + KEYED_AT_ONCE]
            joined = gap.join([lines[i] for i in own]) + gap * 2
            letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
            n = len(letters) - run + 1
            runs = np.full(n, np.uint64(run))
            for j in range(run):
                runs *= MIX
                runs += letters[j : j + n]
            runs = _mixed(runs)
            ends = np.cumsum(sizes[own] + run - 1)
            starts = ends - (sizes[own] + run - 1)
            runs[(starts + sizes[own])[:, None] + np.arange(run - 1)] = runs[starts, None]  # these reach into the next line
            hashes, least = np.empty_like(runs), np.empty((KEYS, ROWS, len(own)), dtype=np.uint64)
            for odd, line in zip(ODD, least.reshape(KEYS * ROWS, -1)):
                np.multiply(runs, odd, out=hashes)
                np.minimum.reduceat(hashes, starts, out=line)
            least >>= np.uint64(32)
            keys = np.repeat((np.arange(KEYS, dtype=np.uint64) * np.uint64(16) + np.uint64(run))[:, None], len(own), axis=1)
            for row in range(ROWS):
                keys = keys * MIX + least[:, row]
            places.append(np.repeat(own, KEYS))
            found.append(_mixed(keys).T.ravel())
    return np.concatenate(places), np.concatenate(found).view(np.int64)


def line_keys(lines: list[str]) -> list[np.ndarray]:
    """The keys of each of some normalised lines, see ``keyed_lines``."""
    places, keys = keyed_lines(lines)
    order = np.argsort(places, kind="stable")
    return np.split(keys[order], np.searchsorted(places[order], np.arange(1, len(lines)))) if lines else []


def line_simhashes(lines: list[str]) -> np.ndarray:
    """SimHashes of the distinct words of normalised lines, so that a mark between all words counts once; 0 without words."""
    out = np.zeros(len(lines), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(lines), AT_ONCE):
        words = [set(line.split(" ")) if line else () for line in lines[at : at + AT_ONCE]]
        sizes = np.array([len(w) for w in words])
        some = np.flatnonzero(sizes)
        if not len(some):
            continue
        codes = np.fromiter(map(digest, chain.from_iterable(words)), dtype="<u8", count=sizes.sum())
        bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(sizes) - sizes)[some]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[at + some] = np.packbits(2 * ones > sizes[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def line_simhash(line: str) -> int:
    return int(line_simhashes([line])[0])


def _least(up: int, down: int, j: int, m: int, n: int) -> int:
    """The least distance that a column of ``m`` letters leaves open after ``j`` of ``n`` letters."""
    size = m // 8 + 1
    steps = [np.unpackbits(np.frombuffer(bits.to_bytes(size, "little"), np.uint8), bitorder="little")[:m].view(np.int8) for bits in (up, down)]
    column = np.concatenate([[0], np.cumsum(steps[0] - steps[1], dtype=np.int64)]) + j
    return int((column + np.abs(np.arange(m, -1, -1) - (n - j))).min())


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance by bit-parallel columns; ``most + 1`` or more if it exceeds ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    begin = len(commonprefix([a, b]))
    a, b = a[begin:], b[begin:]
    end = len(commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    look = max(32, len(b) // 12)  # columns after which the whole column is looked at
    for j, c in enumerate(b):
        if j % look == 0 and j and _least(up, down, j, len(a), len(b)) > most:
            return most + 1
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            distance += 1
        elif mh & top:
            distance -= 1
        if distance - (len(b) - 1 - j) > most:
            return most + 1
        ph = (ph << 1 | 1) & full
        mh = (mh << 1) & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
    return distance


def common_letters(a: str, b: str, i: int, j: int) -> int:
    """How many letters of ``a`` from ``i`` and ``b`` from ``j`` are the same."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 32
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n += step
        step *= 2
    low, high = n, min(n + step, most)  # the first difference, if any, is before ``high``
    while low < high:
        mid = (low + high + 1) // 2
        if a[i + low : i + mid] == b[j + low : j + mid]:
            low = mid
        else:
            high = mid - 1
    return min(low, most)


def edits_enough(a: str, b: str, most: int) -> int:
    """So many edits surely turn ``a`` into ``b``, more than ``most`` if that isn't seen: the next letters in common follow each edit."""
    i = j = edits = 0
    while edits <= most:
        same = common_letters(a, b, i, j)
        i, j = i + same, j + same
        rest = max(len(a) - i, len(b) - j)
        for skip in range(REACH):
            letters = a[i + skip : i + skip + ANCHOR]
            if len(letters) < ANCHOR:
                return edits + rest
            at = b.find(letters, j, j + skip + REACH)
            if at >= 0:
                break
        else:
            return most + 1
        edits += max(skip, at - j)
        i, j = i + skip, at
    return edits


def alike(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if edits_enough(a, b, most) <= most:
        return True
    return edit_distance(a, b, most) <= most


def within(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Which pairs of lines, the shorter one first, as code points, are at most ``most`` edits apart; all are compared at once.

    Cell (i, j) of the table of distances lies on diagonal j - i. Cells of equal
    i + j don't hang on each other, and those of i + j - 2 lie on the same
    diagonals, so two rows of numbers for each pair, of even and odd diagonals, take turns.
    Only diagonals that ``most`` edits can reach are kept. The first even one of a
    pair is -2 ``half``, and letters are laid out so that at each turn all pairs
    need the same rows of them.
    """
    short, long = (np.array([len(pair[side]) for pair in pairs]) for side in (0, 1))
    gap, total = long - short, long + short
    spare = (most - gap) // 2
    half = (spare + 1) // 2
    size = int(((gap + spare + 2 * half + 2) // 2).max())
    last = int(total.max())
    middle = last // 2 + 1
    a, b = (np.full((middle + size + 2, len(pairs)), pad, dtype=np.uint16) for pad in (LETTERS, LETTERS + 1))
    for p, (x, y) in enumerate(pairs):
        a[middle - len(x) + 1 + half[p] : middle + 1 + half[p], p] = x[::-1]
        b[1 + half[p] : 1 + half[p] + len(y), p] = y
    a, b = a.view(np.int16), b.view(np.int16)
    even, odd = (np.full((size + 1, len(pairs)), FAR, dtype=np.int16) for _ in range(2))  # with a row beyond: the last one, the first one
    ones = np.ones((size, len(pairs)), dtype=np.uint16)
    even[half, np.arange(len(pairs))] = 0
    end = half + gap // 2
    steps = 2 * np.arange(size)[:, None]
    to_end = [np.abs(gap + 2 * half - steps - one).astype(np.int16) for one in (0, 1)]
    out, open_pairs = np.zeros(len(pairs), dtype=bool), np.arange(len(pairs))
    one = np.int16(1)
    turns = np.sort(total).tolist()[::-1]
    look = max(64, last // 24)
    for turn in range(1, last + 1):
        if turn % 2:
            own, other = odd[1:], even
            above = middle + 1 - (turn - 1) // 2
        else:
            own, other = even[:-1], odd
            above = middle + 1 - turn // 2
        at = (turn + 1) // 2
        unlike = a[above : above + size] ^ b[at : at + size]
        np.minimum(unlike.view(np.uint16), ones, out=unlike.view(np.uint16))
        unlike += own
        np.minimum(other[:-1], other[1:], out=own)
        np.add(own, one, out=own)
        np.minimum(own, unlike, out=own)
        if turn == turns[-1]:
            ended = np.flatnonzero(total == turn)
            out[open_pairs[ended]] = own[end[ended], ended] <= most[ended]
            while turns and turns[-1] == turn:
                turns.pop()
            if not turns:
                break
        if turn % look == 0:
            least = np.minimum((even[:-1] + to_end[0]).min(axis=0), (odd[1:] + to_end[1]).min(axis=0))
            stay = np.flatnonzero((least <= most) & (total > turn))
            if len(stay) <= 0.8 * len(total):
                if not len(stay):
                    break
                a, b, even, odd = (np.ascontiguousarray(x[:, stay]) for x in (a, b, even, odd))
                to_end, ones = [x[:, stay] for x in to_end], np.ascontiguousarray(ones[:, stay])
                most, total, end, open_pairs = most[stay], total[stay], end[stay], open_pairs[stay]
                turns = np.sort(total).tolist()[::-1]
    return out


def alike_together(pairs: list[tuple[str, str]], similarity: float) -> list[bool]:
    """``alike`` of pairs of lines, best of similar length, see TOGETHER."""
    codes = [tuple(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4") for line in sorted(pair, key=len)) for pair in pairs]
    longer = np.array([len(b) for _, b in codes])
    most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    plain = [i for i, (a, b) in enumerate(codes) if len(b) - len(a) <= most[i] and len(a) and max(a.max(), b.max()) < LETTERS]
    out = [False] * len(pairs)
    for i, near in zip(plain, within([codes[i] for i in plain], most[plain]).tolist() if plain else ()):
        out[i] = near
    for i in set(range(len(pairs))).difference(plain):
        out[i] = alike(*pairs[i], similarity)
    return out


def letter_counts(lines: list[str]) -> np.ndarray:
    """Letters of each line by code point modulo BINS."""
    out = np.empty((len(lines), BINS), dtype=np.int32)
    for row, line in zip(out, lines):
        row[:] = np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4") % BINS, minlength=BINS)
    return out


def may_be_alike(counts: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs have letters enough in common: an edit changes one letter of either line."""
    keep = np.empty(len(left), dtype=bool)
    size = counts.sum(axis=1)
    for at in range(0, len(left), PAIRS_AT_ONCE):
        a, b = left[at : at + PAIRS_AT_ONCE], right[at : at + PAIRS_AT_ONCE]
        gap = counts[a] - counts[b]
        more = np.maximum(gap, 0).sum(axis=1)
        edits = np.maximum(more, more - gap.sum(axis=1))
        keep[at : at + PAIRS_AT_ONCE] = edits <= (1 - similarity) * np.maximum(size[a], size[b]) + 1e-9
    return keep


def near_pairs(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one cell, two by two, within RADIUS; PAIRS_AT_ONCE and what one step adds at once, so that no task holds all its pairs.

    Rows are sorted by cell and compared with the next one, the one after that
    and so on, all cells at once, as far as the cell is the same.
    """
    codes, cells = frame["code"].to_numpy().view(np.uint64), frame["cell"].to_numpy()
    order = np.lexsort((codes, cells))
    codes, cells = codes[order], cells[order]
    open_rows, step, found, n = np.arange(len(cells)), 0, [], 0
    while len(open_rows):
        step += 1
        open_rows = open_rows[open_rows + step < len(cells)]
        open_rows = open_rows[cells[open_rows + step] == cells[open_rows]]
        near = open_rows[np.bitwise_count(codes[open_rows] ^ codes[open_rows + step]) <= RADIUS]
        found.append((near, near + step))
        n += len(near)
        if n and (n >= PAIRS_AT_ONCE or not len(open_rows)):
            yield tuple(order[np.concatenate(side)] for side in zip(*found))
            found, n = [], 0


def _dealt(keyed: DataFrame, tasks: int) -> DataFrame:
    """Rows of shards of ``n`` lines, with the pair of parts under which they are compared.

    A shard of p parts is compared as p (p + 1) / 2 pairs of parts, each in a
    group of its own; a row goes to the p pairs that its part belongs to.
    """
    return (
        keyed.withColumn("parts", F.ceil(F.col("n") / SHARD_ROWS).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("line_id", "shard"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("cell", F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")))
        .withColumn("task", F.pmod("cell", F.lit(tasks)))
        .drop("n", "parts", "part", "other")
    )


def partners(frame: pd.DataFrame) -> pd.DataFrame:
    """Lines and shards in which a line meets another within RADIUS."""
    near = np.zeros(len(frame), dtype=bool)
    for left, right in near_pairs(frame):
        near[left] = near[right] = True
    return frame.loc[near, ["line_id", "shard"]].drop_duplicates()


def verified(frame: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between alike lines of the shards of one task.

    Two lines already linked are not compared again; letter counts settle most
    pairs that are not alike. Lines that meet in several shards are compared in the
    lowest of them only. Longer lines that are not quickly seen to be alike wait
    and are compared many at once.
    """
    names, texts, shards = frame["line_id"].tolist(), frame["line"].tolist(), frame["shard"].tolist()
    everywhere = [frozenset(own) for own in frame["everywhere"]]
    _, first, own = np.unique(names, return_index=True, return_inverse=True)  # a line stands in several cells
    counts, same = letter_counts([texts[i] for i in first]), own.tolist()
    up = list(range(len(first)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def apart(x: int, y: int) -> bool:
        return root(same[x]) != root(same[y])

    links, waiting = [], []

    def link(x: int, y: int) -> None:
        up[root(same[y])] = root(same[x])
        links.append((names[x], names[y]))

    def compare_waiting() -> None:
        waiting.sort(key=lambda pair: len(texts[pair[0]]) + len(texts[pair[1]]))
        while waiting:
            pairs, width = [], 1
            while waiting and width * len(pairs) < CELLS:
                x, y = waiting.pop()
                if apart(x, y):
                    pairs.append((x, y))
                    width = max(width, int((1 - similarity) * max(len(texts[x]), len(texts[y]))) // 2 + 2)
            found = alike_together([(texts[x], texts[y]) for x, y in pairs], similarity)
            for (x, y), near in zip(pairs, found):
                if near and apart(x, y):
                    link(x, y)

    for a, b in near_pairs(frame):
        group = np.array([root(i) for i in range(len(up))])[own]
        open_pairs = group[a] != group[b]
        a, b = a[open_pairs], b[open_pairs]
        close = may_be_alike(counts, own[a], own[b], similarity)
        for x, y in zip(a[close].tolist(), b[close].tolist()):
            if apart(x, y) and shards[x] == min(everywhere[x] & everywhere[y]):
                longer = max(len(texts[x]), len(texts[y]))
                most = int((1 - similarity) * longer + 1e-9)
                if not TOGETHER[0] <= longer <= TOGETHER[1]:
                    if alike(texts[x], texts[y], similarity):
                        link(x, y)
                elif edits_enough(texts[x], texts[y], most) <= most:
                    link(x, y)
                else:
                    waiting.append((x, y))
        if len(waiting) >= WAITING:
            compare_waiting()
    compare_waiting()
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def normalised(text: str | None) -> list[str]:
    """The lines of a text in lower case, with runs of white space as one blank, trimmed."""
    if text is None:
        return []
    text = text.lower()
    for space in ASCII_SPACES if text.isascii() else SPACES:
        if space in text:
            text = text.replace(space, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return [line.strip(" ") for line in text.split("\n")]


def line_id(line: str) -> int:
    """A 64-bit hash of a normal form, never 0, which stands for an empty line."""
    return (xxhash.xxh64_intdigest(line) or 1) if line else 0


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def occurrences(docs: DataFrame, text: str) -> DataFrame:
    """``(doc_id, text_id, line_no, line_id)``: all lines that aren't empty, without their letters."""

    @F.pandas_udf("array<long>")
    def look(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed([line_id(x) for x in normalised(one)]) for one in texts], dtype=object)

    return (
        docs.select("doc_id", F.xxhash64(text).alias("text_id"), F.posexplode(look(F.col(text))).alias("at", "line_id"))
        .select("doc_id", "text_id", (F.col("at") + 1).alias("line_no"), "line_id")
        .where("line_id != 0")
    )


def common_keys(frame: pd.DataFrame) -> pd.DataFrame:
    """``(line_id, shard, n)``: of the keys of one bucket those that ``n`` lines have, two or more."""
    keys, lines = (np.concatenate(frame[c].to_list()) for c in ("keys", "lines"))
    order = np.argsort(keys)
    keys, lines = keys[order], lines[order]
    same = keys[1:] == keys[:-1]
    some = np.append(same, False) | np.insert(same, 0, False)
    keys, lines = keys[some], lines[some]
    order = np.lexsort((lines, keys))
    keys, lines = keys[order], lines[order]
    fresh = np.ones(len(keys), dtype=bool)  # a line that several tasks have read has its keys several times
    fresh[1:] = (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1])
    keys, lines = keys[fresh], lines[fresh]
    _, each, n = np.unique(keys, return_inverse=True, return_counts=True)
    many = n[each] > 1
    return pd.DataFrame({"line_id": lines[many], "shard": keys[many], "n": n[each][many]})


def shared_keys(docs: DataFrame, text: str, n_lines: int) -> DataFrame:
    """``(line_id, shard, n)``: the keys that ``n`` different lines have, two or more.

    Keys leave their task as arrays, one for each bucket of keys and batch of
    texts, and so meet without a row for each of them.
    """
    buckets = max(1, KEYS * n_lines // BUCKET_KEYS)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                lines = {line_id(x): x for one in batch["text"].iloc[at : at + AT_ONCE] for x in normalised(one) if x}
                places, keys = keyed_lines(list(lines.values()))
                bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                names, starts = np.unique(bucket[order], return_index=True)
                yield pd.DataFrame(
                    {
                        "bucket": names,
                        "keys": pd.Series(np.split(keys[order], starts)[1:], dtype=object),
                        "lines": pd.Series(np.split(_signed(list(lines))[places][order], starts)[1:], dtype=object),
                    }
                )

    packed = docs.select(F.col(text).cast("string").alias("text")).mapInPandas(look, "bucket long, keys array<long>, lines array<long>")
    return packed.groupBy("bucket").applyInPandas(common_keys, "line_id long, shard long, n long")


def line_texts(docs: DataFrame, text: str) -> DataFrame:
    """``(line_id, line)``: the normal form of every line that isn't empty."""

    @F.pandas_udf("ids array<long>, lines array<string>")
    def look(texts: pd.Series) -> pd.DataFrame:
        lines = [normalised(one) for one in texts]
        return pd.DataFrame({"ids": [_signed([line_id(x) for x in own]) for own in lines], "lines": lines})

    zipped = F.arrays_zip(F.col("l.ids").alias("line_id"), F.col("l.lines").alias("line"))
    return docs.select(look(F.col(text)).alias("l")).select(F.inline(zipped)).where("line_id != 0")


def line_groups(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, n_lines: int | None = None) -> DataFrame:
    """``(line_id, root)`` for every line in a group of several different lines.

    Two lines link if their edit similarity is ``similarity`` or more. Candidates
    are lines that share a key (see ``keyed_lines``) and whose SimHashes differ in
    RADIUS bits or less; only lines that share a key are read again, and those with
    a partner meet, as texts, in the shards where they have one. Of shards with the
    same lines one is enough. ``n_lines``, if known, says how many lines there are.
    """

    @F.pandas_udf("long")
    def code(lines: pd.Series) -> pd.Series:
        return pd.Series(line_simhashes(lines.tolist()).view(np.int64))

    n_lines = occurrences(docs, text).count() if n_lines is None else n_lines
    shared = cut_lineage(shared_keys(docs, text, n_lines))
    wanted = cut_lineage(shared.select("line_id").distinct())
    few = wanted.count() <= BROADCAST_IDS
    texts = line_texts(docs, text).join(F.broadcast(wanted) if few else wanted, "line_id").groupBy("line_id").agg(F.min("line").alias("line"))
    texts = cut_lineage(texts.withColumn("code", code("line")))
    codes = texts.select("line_id", "code")
    tasks = max(1, KEYS * n_lines // TASK_ROWS)
    keyed = shared.join(F.broadcast(codes) if few else codes, "line_id")
    met = cut_lineage(_dealt(keyed, tasks).groupBy("task").applyInPandas(partners, "line_id long, shard long").distinct())
    members = met.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("line_id"), 20)).alias("a"), F.bit_xor(F.xxhash64("line_id")).alias("b"))
    met = cut_lineage(met.join(members.groupBy("n", "a", "b").agg(F.min("shard").alias("shard")).select("shard", "n"), "shard"))
    at = met.groupBy("line_id").agg(F.collect_set(F.struct("shard", "n")).alias("at"))
    rows = texts.join(at, "line_id").select("line_id", "code", "line", F.col("at.shard").alias("everywhere"), F.inline("at"))
    tasks = max(1, met.count() * 10 // TASK_ROWS)
    links = _dealt(rows, tasks).groupBy("task").applyInPandas(lambda frame: verified(frame, similarity), "a long, b long")
    return connected(links).select(F.col("node").alias("line_id"), "root")


def dedup_lines(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one more column ``lines``: ``text`` of the lines that stay, ``n_lines``, ``n_kept`` and ``dropped``.

    Lines end at \\n. Their normal form is lower-cased, with runs of white space
    as one blank, and trimmed. Lines of equal normal form, and linked ones (see
    ``line_groups``), are one group, and of a group only the first occurrence
    stays: by ``doc_id``, those without one last, then by line number. Empty
    lines always stay. ``dropped`` are the numbers of the lines that go, from 1.
    Rows that repeat ``doc_id`` and text are one document, and both rows keep its
    lines. A null text has no lines and stays null. No rows, no rows.

    A line that fills a third of all rows is one row per task when groups and
    first occurrences are found; its occurrences are joined to that, which Spark
    may split.
    """
    name = free_name(docs, "lines")
    found = cut_lineage(occurrences(docs, text))
    spot = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id", "line_no")
    groups = line_groups(docs, text, similarity, found.count())
    twice = found.groupBy("line_id").agg(F.count("*").alias("n")).where("n > 1").select("line_id", F.col("line_id").alias("root"))
    named = cut_lineage(groups.union(twice).groupBy("line_id").agg(F.min("root").alias("root")))  # a group's root is its lowest line
    few = named.count() <= BROADCAST_IDS
    many = cut_lineage(found.join(F.broadcast(named) if few else named, "line_id"))
    best = cut_lineage(many.groupBy("root").agg(F.min(spot).alias("best")))
    gone = (
        many.join(F.broadcast(best) if few else best, "root")
        .where(~spot.eqNullSafe(F.col("best")))
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("text_id").alias("gone_text"))
        .agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    )
    gone = cut_lineage(gone)
    few = (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BROADCAST_IDS
    rows = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_text"))
    rows = rows.join(F.broadcast(gone) if few else gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_text") == F.col("gone_text")), "left")
    rows = rows.withColumn("parts", F.split(F.col("row")[text], "\n", -1))
    rows = rows.withColumn("kept", F.when(F.col("gone").isNotNull(), F.filter("parts", lambda _, i: ~F.array_contains(F.col("gone"), i + 1))))
    n_lines = F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts"))
    return rows.select(
        "row.*",
        F.struct(
            F.when(F.col("gone").isNull(), F.col("row")[text].cast("string")).otherwise(F.array_join("kept", "\n")).alias("text"),
            n_lines.alias("n_lines"),
            F.when(F.col("kept").isNull(), n_lines).otherwise(F.size("kept")).alias("n_kept"),
            F.coalesce("gone", F.array().cast("array<int>")).alias("dropped"),
        ).alias(name),
    )


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "lines.*")


QUERIES = {"op3_fuzzy_lines": op3_fuzzy_lines}
