"""Substring deduplication by collinear chaining.

Of every window of WINDOW word k-mers the least hash is kept as a seed, so a passage of SEED_WORDS + WINDOW - 1 equal words shares one at least.
Seeds that occur in several documents are joined with their first holder first, the smallest id, so a passage that n documents share costs n
anchors and not n squared. The anchors of a document and a holder are chained: a Fenwick tree over the holder's positions finds the best
predecessor of each under a cost for every word passed over. Chains are then aligned word by word: mismatches on a diagonal, edit distance
where the diagonal changes, and extension at both ends until too many words differ. Even a chain of one seed is aligned, since its
neighbours may have other holders. What is long and alike enough is a fuzzy passage; a chain that is not is parted where it differs most.
A seed that then lies in no passage of its text is open, and is compared with all its other holders, however many they are: the words around
both places tell whether the two texts may be alike for long enough there, and those that may are chained and aligned as well. So every seed
of a text either lies in a passage that is reported, or has been compared with each holder.

Words are split at blanks and 0x09-0x0D, A-Z lowered; positions count words. Null or empty texts have no passage. Rows without id are left
out; rows with equal ids count as one document and are never matched with each other. A text that repeats a passage within itself is not
reported for that. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from factloom.llm.store import narrow, stored
from factloom.llm.words import Piece, Scanner

SEED_WORDS = 6
WINDOW = 12
MIN_WORDS = 50
MIN_IDENTITY = 0.8
# Cost of a chain for each word passed over on either side, in words matched.
GAP_COST = 0.1
# Words looked at beyond the ends of a chain; extension stops when the score falls so far below its best.
REACH, DROP = 96, 8
MISMATCH = 2
# Bits for the ids of the texts that a join needs, 8 MB.
ID_BITS = 1 << 26
# Words that the first seed of a chain pays for: other seeds as near as that may follow it.
PAID = int(SEED_WORDS / GAP_COST)
# Holders of a seed that one task compares with as many others, and pairs compared at once.
BLOCK, AT_ONCE = 8192, 1 << 18
# Stands for words beyond the text of an open seed; 0 for those of other holders, so that they are never equal.
BEYOND = 0xFFFF


def minimizers(piece: Piece, k: int = SEED_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and hash of the seeds, each hash once per text."""
    grams, inside = piece.ngrams(k)
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, grams[:0]
    own, row = grams[at], piece.row_of_word()[at]
    least, where = own.copy(), np.arange(len(own))
    for shift in range(1, window):
        if shift >= len(own):
            break
        # A window ends at the last k-mer of its text; the least so far stays there.
        lower = (own[shift:] < least[:-shift]) & (row[shift:] == row[:-shift])
        least[:-shift][lower], where[:-shift][lower] = own[shift:][lower], np.arange(shift, len(own))[lower]
    # Windows cut short by the text's end count only if they are its only one.
    left = np.searchsorted(row, row, "right") - np.arange(len(row))
    begins = np.concatenate([[True], row[1:] != row[:-1]])
    chosen = np.unique(where[(left >= window) | begins])
    # A text that repeats few words without end has one seed at many places; the longest stretch of them stands for all.
    new = np.concatenate([[True], (own[chosen][1:] != own[chosen][:-1]) | (chosen[1:] != chosen[:-1] + 1) | (row[chosen][1:] != row[chosen][:-1])])
    stretch = np.diff(np.append(np.flatnonzero(new), len(chosen)))
    heads = chosen[new]
    order = np.lexsort((heads, -stretch, own[heads], row[heads]))
    heads = heads[order]
    chosen = heads[np.concatenate([[True], (own[heads][1:] != own[heads][:-1]) | (row[heads][1:] != row[heads][:-1])])]
    return row[chosen], at[chosen] - piece.rows[row[chosen]], own[chosen]


def _seeds(batches):
    scanner = Scanner()
    for batch in batches:
        ids = batch["d"].to_numpy(zero_copy_only=False)
        for piece in scanner.pieces(batch["t"]):
            row, word, own = minimizers(piece)
            yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(ids[piece.first + row]), pa.array(word.astype(np.int32))], ["h", "d", "p"])


def chains(p: np.ndarray, s: np.ndarray, weight: float = SEED_WORDS, gap: float = GAP_COST) -> list[list[int]]:
    """Anchors (p, s) as disjoint collinear chains, best first.

    score(j) = weight + max(0, score(i) - gap * (p_j - p_i + s_j - s_i)) over i with p_i < p_j and s_i < s_j. The gap cost splits into a part of i and
    a part of j, so a Fenwick tree of prefix maxima over the order of s answers it in logarithmic time.
    """
    n = len(p)
    rank = np.searchsorted(np.unique(s), s) + 1
    size = int(rank.max()) if n else 0
    best, score, before = [(-1e18, -1)] * (size + 1), np.zeros(n), np.full(n, -1)
    order, k = np.lexsort((s, p)), 0
    while k < n:
        same = k
        while same < n and p[order[same]] == p[order[k]]:
            j = order[same]
            top, i = (-1e18, -1), rank[j] - 1
            while i > 0:
                top = max(top, best[i])
                i -= i & -i
            gain = top[0] - gap * (p[j] + s[j])
            score[j], before[j] = (weight + gain, top[1]) if gain > 0 else (weight, -1)
            same += 1
        # Anchors at one place of p can't follow each other, so they enter the tree together.
        for j in order[k:same]:
            entry, i = (score[j] + gap * (p[j] + s[j]), int(j)), rank[j]
            while i <= size:
                best[i] = max(best[i], entry)
                i += i & -i
        k = same
    used, out = np.zeros(n, bool), []
    for j in np.argsort(-score, kind="stable"):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(int(j))
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


def _chained(batches):
    for batch in batches:
        d, s, rows = batch["d"].to_numpy(), batch["s"].to_numpy(), batch["anchors"]
        ends, flat = rows.offsets.to_numpy(), rows.values
        p_all, q_all = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        out = ([], [], [], [])
        for row in range(batch.num_rows):
            p, q = p_all[ends[row]: ends[row + 1]], q_all[ends[row]: ends[row + 1]]
            for chain in chains(p, q):
                for column, value in zip(out, (d[row], s[row], p[chain], q[chain])):
                    column.append(value)
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int32()))],
                              ["d", "s", "p", "q"])


def _word_rows(scanner: Scanner, ids: np.ndarray, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and 32-bit word hashes; rows that follow each other with one id and text are scanned once."""
    n = len(ids)
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (lengths[1:] != lengths[:-1])]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], n)
    for piece in scanner.pieces(texts.take(pa.array(starts))):
        words = (piece.hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        for own in range(len(piece)):
            for row in range(starts[piece.first + own], stops[piece.first + own]):
                yield row, words[piece.rows[own]: piece.rows[own + 1]]


def _windows(batches):
    scanner = Scanner()
    for batch in batches:
        q, q_ends = batch["q"].values.to_numpy(), batch["q"].offsets.to_numpy()
        begins, held = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
        for row, words in _word_rows(scanner, batch["s"].to_numpy(), batch["t"]):
            own = q[q_ends[row]: q_ends[row + 1]]
            begins[row] = max(0, own[0] - REACH)
            held[row] = words[begins[row]: own[-1] + SEED_WORDS + REACH]
        yield pa.record_batch([batch["d"], batch["s"], batch["p"], batch["q"], pa.array(begins), pa.array(held, pa.list_(pa.int32()))],
                              ["d", "s", "p", "q", "begin", "words"])


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words to add of two runs that are read outwards, and mismatches among them."""
    n = min(len(a), len(b), REACH)
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -MISMATCH))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
    stop = fallen[0] if len(fallen) else n
    if not stop or score[:stop].max() <= 0:
        return 0, 0
    take = int(np.argmax(score[:stop])) + 1
    return take, int((~same[:take]).sum())


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Word edits that turn a into b."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for k, word in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != word))
        # Insertions along the row: the least of all earlier cells plus the distance to them.
        row = np.minimum.accumulate(np.concatenate([[k], best]) - steps) + steps
    return int(row[-1])


def align(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, k: int = SEED_WORDS) -> tuple[int, int, int, int, int]:
    """First and last + 1 word in a and in b, and edits, of the passage around the chain of anchors (p, q)."""
    edits, step = 0, p - q
    turn = np.flatnonzero(step[1:] != step[:-1])
    cuts = np.concatenate([[0], turn + 1, [len(p)]])
    for i, j in zip(cuts[:-1], cuts[1:]):
        edits += int((a[p[i]: p[j - 1] + k] != b[q[i]: q[j - 1] + k]).sum())
    for i in turn:
        pa_, pb = p[i] + k, q[i] + k
        lap = max(0, pa_ - p[i + 1], pb - q[i + 1])
        edits += edit_distance(a[pa_ - lap: p[i + 1]], b[pb - lap: q[i + 1]]) if lap else edit_distance(a[pa_: p[i + 1]], b[pb: q[i + 1]])
    left, more = _extend(a[: p[0]][::-1], b[: q[0]][::-1])
    right, yet = _extend(a[p[-1] + k:], b[q[-1] + k:])
    return int(p[0] - left), int(p[-1] + k + right), int(q[0] - left), int(q[-1] + k + right), edits + more + yet


def _step_edits(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Edits between each anchor of a chain and the next."""
    out = np.zeros(len(p) - 1, np.int64)
    for i in range(len(p) - 1):
        x, y, x2, y2 = p[i] + k, q[i] + k, p[i + 1], q[i + 1]
        if x2 - x == y2 - y:
            out[i] = (a[x: x2] != b[y: y2]).sum() if x2 > x else 0
        else:
            lap = max(0, x - x2, y - y2)
            out[i] = edit_distance(a[x - lap: x2], b[y - lap: y2])
    return out


def matches(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, min_words: int, min_identity: float, k: int = SEED_WORDS) -> list[tuple]:
    """The passages around a chain, as align tells them, that are long and alike enough.

    A chain may lead through words that differ from one passage to the next, and an end may be extended too far. Where the whole does not
    meet the threshold, its ends are left out, then it is parted at its worst step, as often as a part may still hold a passage.
    """
    size = lambda m: min(m[1] - m[0], m[3] - m[2])
    fits = lambda m: size(m) >= min_words and m[4] <= (1 - min_identity) * max(m[1] - m[0], m[3] - m[2])
    whole = align(a, b, p, q, k)
    if fits(whole) or size(whole) < min_words:
        return [whole] if fits(whole) else []
    steps, out, parts = _step_edits(a, b, p, q, k), [], [(0, len(p))]
    while parts:
        i, j = parts.pop()
        x, x2, y, y2, edits = int(p[i]), int(p[j - 1] + k), int(q[i]), int(q[j - 1] + k), int(steps[i: j - 1].sum())
        (left, more), (right, yet) = _extend(a[:x][::-1], b[:y][::-1]), _extend(a[x2:], b[y2:])
        tries = [(x - l, x2 + r, y - l, y2 + r, edits + m + n) for l, m, r, n in ((left, more, right, yet), (left, more, 0, 0), (0, 0, right, yet), (0, 0, 0, 0))]
        good = max(filter(fits, tries), key=size, default=None)
        if good:
            out.append(good)
        elif j - i > 1 and size(tries[0]) >= min_words:
            cut = i + int(np.argmax(steps[i: j - 1])) + 1
            parts += [(cut, j), (i, cut)]
    return out


def _aligned(min_words: int, min_identity: float):
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            s, begins = batch["s"].to_numpy(), batch["begin"].to_numpy()
            columns = {c: (batch[c].values.to_numpy(), batch[c].offsets.to_numpy()) for c in ("p", "q", "words")}
            part = lambda c, row: columns[c][0][columns[c][1][row]: columns[c][1][row + 1]]
            d, out = batch["d"].to_numpy(), []
            for row, words in _word_rows(scanner, d, batch["t"]):
                p, q, other = part("p", row), part("q", row) - begins[row], part("words", row)
                if p[-1] + SEED_WORDS > len(words) or q[-1] + SEED_WORDS > len(other):
                    continue  # another text of the same id
                for a, b, x, y, edits in matches(words, other, p, q, min_words, min_identity):
                    out.append((d[row], a, b, s[row], x + begins[row], y + begins[row], edits))
            columns_ = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns_, kinds)], ["d", "a", "b", "s", "x", "y", "edits"])

    return run


def _open_ranges(min_words: int):
    """Word ranges of a text that may hold a passage of equal words: seeds of other texts follow each other there, and no passage found covers all."""
    def run(batches):
        for batch in batches:
            ids, out = batch["d"].to_numpy(), ([], [], [])
            held, held_ends = batch["held"].values.to_numpy(), batch["held"].offsets.to_numpy()
            found = batch["found"].to_pylist()
            for row in range(batch.num_rows):
                p = np.sort(held[held_ends[row]: held_ends[row + 1]])
                cuts = np.flatnonzero(np.diff(p) > 3 * WINDOW) + 1
                low = np.maximum(p[np.concatenate([[0], cuts])] - WINDOW, 0)
                high = p[np.concatenate([cuts, [len(p)]]) - 1] + SEED_WORDS + WINDOW
                for begin, end in zip(low, high):
                    # A window of min_words is settled if it lies in one passage; its start then is in [first, last].
                    settled = sorted((x["a"], x["b"] - min_words) for x in found[row] or () if x["b"] - min_words >= begin and x["a"] < end)
                    at = int(begin)
                    for first, last in [*settled, (int(end), int(end))]:
                        if min(first, end - min_words + 1) > at:
                            for column, value in zip(out, (ids[row], at, min(first, int(end) - min_words + 1))):
                                column.append(value)
                        at = max(at, last + 1)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["d", "a", "b"])

    return run


def _long_seeds(min_words: int):
    """The n-grams of min_words words that begin in the open ranges (a to b) of each text."""
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            ids, ranges = batch["d"].to_numpy(zero_copy_only=False), batch["ranges"].to_pylist()
            for piece in scanner.pieces(batch["t"]):
                grams, inside = piece.ngrams(min_words)
                for own in range(len(piece)):
                    begin, end = piece.rows[own], piece.rows[own + 1]
                    wanted = np.zeros(end - begin, bool)
                    for r in ranges[piece.first + own]:
                        wanted[r["a"]: r["b"]] = True
                    at = np.flatnonzero(wanted & inside[begin:end])
                    if len(at):
                        yield pa.record_batch([pa.array(grams[begin + at].view(np.int64)), pa.array(np.full(len(at), ids[piece.first + own])), pa.array(at.astype(np.int32))], ["h", "d", "p"])

    return run


def _runs(min_words: int):
    """Anchors of long n-grams as chains: those that follow each other on a diagonal, with the last seed of the last one."""
    def run(batches):
        for batch in batches:
            d, s, rows = batch["d"].to_numpy(), batch["s"].to_numpy(), batch["anchors"]
            ends, flat, out = rows.offsets.to_numpy(), rows.values, ([], [], [], [])
            p_all, q_all = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for row in range(batch.num_rows):
                p, q = p_all[ends[row]: ends[row + 1]], q_all[ends[row]: ends[row + 1]]
                order = np.lexsort((p, q - p))
                p, q = p[order], q[order]
                cuts = np.flatnonzero((np.diff(q - p) != 0) | (np.diff(p) != 1)) + 1
                for x, y in zip(np.split(p, cuts), np.split(q, cuts)):
                    tail = min_words - SEED_WORDS
                    for column, value in zip(out, (d[row], s[row], np.append(x, x[-1] + tail), np.append(y, y[-1] + tail))):
                        column.append(value)
            lists = pa.list_(pa.int32())
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], lists), pa.array(out[3], lists)], ["d", "s", "p", "q"])

    return run


def _seeds_and_cover(batches):
    """The seeds (d, p, s, q) of each text, and whether no passage found holds them."""
    for batch in batches:
        seeds, ends = batch["seeds"].values, batch["seeds"].offsets.to_numpy()
        found, found_ends = batch["found"].values, batch["found"].offsets.to_numpy()
        p, a, b = seeds.field(0).to_numpy(), found.field(0).to_numpy(), found.field(1).to_numpy()
        is_open = np.ones(len(p), bool)
        for row in np.flatnonzero(np.diff(found_ends)):
            own, held = slice(ends[row], ends[row + 1]), slice(found_ends[row], found_ends[row + 1])
            order = np.argsort(a[held])
            # The furthest end of the passages that begin at or before a seed.
            reach = np.concatenate([[-1], np.maximum.accumulate(b[held][order])])
            is_open[own] = reach[np.searchsorted(a[held][order], p[own], "right")] < p[own] + SEED_WORDS
        part = slice(ends[0], ends[-1])
        d = np.repeat(batch["d"].to_numpy(), np.diff(ends))
        yield pa.record_batch([pa.array(d), pa.array(p[part]), seeds.field(1)[part], seeds.field(2)[part], pa.array(is_open[part])], ["d", "p", "s", "q", "open"])


def _surroundings(min_words: int):
    """The words around each seed that is to be compared, outwards in 16 bits (0 beyond the text), and the seeds near it with a hash of the words up to them."""
    side = max(min_words - SEED_WORDS, 1)
    places = np.concatenate([np.arange(side)[::-1], np.arange(side) + side + SEED_WORDS])
    base = 0x9E3779B97F4A7C15 | 1

    def powers(factor: int, n: int) -> np.ndarray:
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, factor, np.uint64))])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        s, q, n, d, p, is_open, around, sizes, keys, paths = (np.concatenate(c) for c in zip(*out))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        bounds = pa.py_buffer(np.arange(len(s) + 1, dtype=np.int32) * (4 * side))
        return pa.record_batch([*map(pa.array, (s, q, n, d, p, is_open)), pa.Array.from_buffers(pa.binary(), len(s), [None, bounds, pa.py_buffer(np.ascontiguousarray(around))]),
                                pa.ListArray.from_arrays(ends, pa.array(keys)), pa.ListArray.from_arrays(ends, pa.array(paths))], ["s", "q", "n", "d", "p", "open", "around", "near", "paths"])

    def run(batches):
        scanner = Scanner()
        up, down = powers(base, 1 << 15), powers(pow(base, -1, 2**64), 1 << 15)
        for batch in batches:
            seeds, ends = batch["seeds"].values, batch["seeds"].offsets.to_numpy()
            columns = [seeds.field(i).to_numpy(zero_copy_only=False) for i in range(5)]
            ids, out, held = batch["d"].to_numpy(), [], 0
            for row, words in _word_rows(scanner, ids, batch["t"]):
                p, s, q, is_open, n = (c[ends[row]: ends[row + 1]] for c in columns)
                order = np.argsort(p, kind="stable")
                order = order[p[order] + SEED_WORDS <= len(words)]  # the others belong to another text of the same id
                p, s, q, is_open, n = p[order].astype(np.int64), s[order], q[order], is_open[order], n[order]
                asked = np.flatnonzero(n)
                if not len(asked):
                    continue
                if len(words) >= len(up):
                    up, down = powers(base, 2 * len(words)), powers(pow(base, -1, 2**64), 2 * len(words))
                short = words.view(np.uint32).astype(np.uint16)
                short[(short == 0) | (short == BEYOND)] = 1
                padded = np.concatenate([np.zeros(side, np.uint16), short, np.zeros(side, np.uint16)])
                at = p[asked]
                around = padded[at[:, None] + places]
                low, high = np.searchsorted(p, at - PAID), np.searchsorted(p, at + PAID, "right")
                sizes = high - low
                own = np.repeat(asked, sizes)
                other = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(short.astype(np.uint64) * up[: len(short)])])
                first, last = np.minimum(p[own], p[other]), np.maximum(p[own], p[other])
                paths = (((sums[last] - sums[first]) * down[first]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                keys = (s[other].astype(np.uint64) * np.uint64(base) + q[other].astype(np.uint64)) * np.uint64(base) + (p[other] > p[own]).astype(np.uint64)
                out.append((s[asked], q[asked], n[asked], np.full(len(asked), ids[row]), at.astype(np.int32), is_open[asked], around, sizes, keys.view(np.int64), paths))
                held += len(asked)
                if held >= 4096:
                    yield packed(out)
                    out, held = [], 0
            if out:
                yield packed(out)

    return run


def _reaches(a: np.ndarray, b: np.ndarray, pairs: tuple | None = None) -> np.ndarray:
    """Words that _extend may take of a run in a and one in b, for the given pairs of rows or all; REACH if these words don't tell."""
    shape, few = ((len(a), len(b)), 16) if pairs is None else (len(pairs[0]), 2)
    kind = np.int8 if MISMATCH * a.shape[1] < 128 else np.int16
    score, top, take = (np.zeros(shape, kind) for _ in range(3))
    going, out, where = np.ones(shape, bool), None, None if pairs is None else (np.arange(shape),)
    for k in range(a.shape[1]):
        if k and k % 4 == 0 and (left := np.count_nonzero(going)) * few < going.size:
            # Few are left: these alone are followed.
            if out is None:
                out = take
            else:
                out[where] = take
            if not left:
                return out
            kept = np.nonzero(going)
            where = kept if where is None else tuple(w[kept] for w in where)
            pairs, few = kept if pairs is None else tuple(i[kept] for i in pairs), 2
            score, top, take, going = score[kept], top[kept], take[kept], going[kept]
        x, y = (a[:, None, k], b[None, :, k]) if pairs is None else (a[pairs[0], k], b[pairs[1], k])
        score += (x == y).view(np.int8) * np.int8(1 + MISMATCH) - np.int8(MISMATCH)
        rises = (score > top) & going
        np.copyto(top, score, where=rises)
        np.copyto(take, k + 1, where=rises)
        going &= top - score <= DROP
    take[going] = REACH
    if out is None:
        return take
    out[where] = take
    return out


def _least_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows, the least word edits of the first 0, 1, 2 … words of a, whatever the words of b they are set against."""
    steps = np.arange(b.shape[1] + 1, dtype=np.int16)
    row = np.repeat(steps[None], len(a), 0)
    out = [row.min(1)]
    for k in range(a.shape[1]):
        best = np.concatenate([np.full((len(a), 1), k + 1, np.int16), np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, k, None] != b))], 1)
        row = (np.minimum.accumulate(best - steps, 1) + steps).astype(np.int16)
        out.append(row.min(1))
    return np.stack(out, 1)


def _may_fit(a: np.ndarray, b: np.ndarray, min_identity: float) -> np.ndarray:
    """Whether as many words around a seed as one side has could be alike enough, or more; words left out or put in count."""
    side = a.shape[1] // 2
    allowed = (1 - min_identity) / min_identity
    spare = [allowed * np.arange(side + 1) - _least_edits(a[:, h], b[:, h]) for h in (slice(0, side), slice(side, 2 * side))]
    # To each number of words on the left, the best of enough words on the right.
    best = np.maximum.accumulate(spare[1][:, ::-1], 1)
    return (spare[0] + best + allowed * SEED_WORDS >= -1e-9).any(1)


def _around_alike(min_words: int, min_identity: float, first: bool):
    """Anchors (d, s, p, q) of open seeds and other holders that may share a passage: the first of each open seed, or all.

    Either the words around both places could be alike for min_words words on one diagonal, as _extend goes, or another seed of both is near
    with other words in between, so that a chain may lead from one to the other, and the edits leave room for a passage around the seed. A
    common line in texts that differ around it has neither.
    """
    side = max(min_words - SEED_WORDS, 1)

    def run(batches):
        for batch in batches:
            ends = batch["rows"].offsets.to_numpy()
            rows = batch["rows"].values[ends[0]: ends[-1]]
            d, p, asks, answers = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            group = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            if not first:
                still, still_ends = batch["still"].values, batch["still"].offsets.to_numpy()
                names = lambda g, d, p: np.stack([g, d, p], 1).astype(np.int64).view("i8,i8,i8").ravel()
                asks = asks & np.isin(names(group, d, p), names(np.repeat(np.arange(batch.num_rows), np.diff(still_ends)), *(still.field(i).to_numpy()[still_ends[0]: still_ends[-1]] for i in range(2))))
            words = np.frombuffer(b"".join(rows.field(4).to_pylist()), np.uint16).reshape(len(d), 2 * side)
            words_x = np.where(words == 0, np.uint16(BEYOND), words)

            def extended(x: np.ndarray, y: np.ndarray, pairs: tuple | None = None) -> np.ndarray:
                return SEED_WORDS + _reaches(x[:, :side], y[:, :side], pairs).astype(np.int16) + _reaches(x[:, side:], y[:, side:], pairs)

            def anchors(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
                x, y = np.where(d[x] > d[y], x, y), np.where(d[x] > d[y], y, x)
                return pa.record_batch([pa.array(d[x]), pa.array(d[y]), pa.array(p[x]), pa.array(p[y])], ["d", "s", "p", "q"])

            # Answers by group and id; each open seed meets those of its group.
            told = np.flatnonzero(answers)
            told = told[np.lexsort((p[told], d[told], group[told]))]
            bounds = np.searchsorted(group[told], np.arange(batch.num_rows + 1))
            asking = np.flatnonzero(asks)
            sizes = np.diff(bounds)[group[asking]]
            asking, sizes = asking[sizes > 0], sizes[sizes > 0]
            total, i, met = np.cumsum(sizes), 0, np.zeros(len(d), bool)
            while i < len(asking):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + AT_ONCE, "right")))
                x = asking[i:j]
                if group[x[0]] == group[x[-1]]:
                    y = told[bounds[group[x[0]]]: bounds[group[x[0]] + 1]]
                    one, two = np.nonzero(extended(words_x[x], words[y]) >= min_words)
                    x, y = x[one], y[two]
                else:
                    x = np.repeat(x, sizes[i:j])
                    y = told[np.arange(len(x)) - np.repeat(np.cumsum(sizes[i:j]) - sizes[i:j], sizes[i:j]) + bounds[group[x]]]
                    good = d[x] != d[y]
                    x, y = x[good], y[good]
                    good = extended(words_x, words, (x, y)) >= min_words
                    x, y = x[good], y[good]
                good = d[x] != d[y]
                x, y = x[good], y[good]
                if first and len(x):
                    good = np.concatenate([[True], x[1:] != x[:-1]])
                    x, y = x[good], y[good]
                    met[x] = True
                if len(x):
                    yield anchors(x, y)
                i = j
            asks = asks & ~met
            near, near_ends, paths = rows.field(5).values.to_numpy(), rows.field(5).offsets.to_numpy(), rows.field(6).values.to_numpy()
            near, paths = near[near_ends[0]: near_ends[-1]], paths[rows.field(6).offsets[0].as_py():][: near_ends[-1] - near_ends[0]]
            row = np.repeat(np.arange(len(d)), np.diff(near_ends))
            alone = np.flatnonzero(np.bincount(group, asks, batch.num_rows)[group[row]] > 0)
            order = alone[np.lexsort((paths[alone], near[alone], group[row[alone]]))]
            row, key, path = row[order], near[order], paths[order]
            if not len(row):
                continue
            low = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[row[1:]] != group[row[:-1]])]))
            high = np.append(low[1:], len(row))
            pairs, held = [], 0

            def fitting() -> np.ndarray:
                kept = np.unique(np.concatenate(pairs))
                x, y = np.divmod(kept, len(d))
                return kept[np.concatenate([_may_fit(words_x[x[i: i + 4096]], words[y[i: i + 4096]], min_identity) for i in range(0, len(x), 4096)])]

            for a, b in np.stack([low, high], 1)[(path[low] != path[high - 1]) & np.logical_or.reduceat(asks[row], low)]:
                mine, ways = row[a:b], path[a:b]
                x, y = np.flatnonzero(asks[mine]), np.flatnonzero(answers[mine])
                many = max(1, AT_ONCE // max(1, len(y)))
                for i in range(0, len(x), many):
                    one, two = np.nonzero((ways[x[i: i + many], None] != ways[None, y]) & (d[mine[x[i: i + many]], None] != d[None, mine[y]]))
                    pairs.append(mine[x[i + one]] * len(d) + mine[y[two]])
                    held += len(one)
                    if held > 4 * AT_ONCE:
                        pairs = [fitting()]
                        held = 0
            if pairs:
                x, y = np.divmod(fitting(), len(d))
                if first and len(x):
                    order = np.lexsort((d[y], x))
                    x, y = x[order], y[order]
                    good = np.concatenate([[True], x[1:] != x[:-1]])
                    x, y = x[good], y[good]
                if len(x):
                    yield anchors(x, y)

    return run


CHAIN = "d long, s long, p array<int>, q array<int>"


def _held(seeds: DataFrame) -> DataFrame:
    """Seeds that several texts hold: d, p with the first holder s and its q; the first holder itself has s = d.

    So s and q name the seed; _behind_first compares the holders among themselves.
    """
    holders = seeds.groupBy("h").agg(F.min(F.struct("d", "p")).alias("first"), F.max("d").alias("last")).filter("last > first.d").select(
        "h", F.col("first.d").alias("s"), F.col("first.p").alias("q"))
    return seeds.join(holders, "h").select("d", "p", "s", "q")


def _anchors(held: DataFrame) -> DataFrame:
    return held.filter("d <> s").groupBy("d", "s").agg(F.collect_list(F.struct("p", "q")).alias("anchors"))


def _open_groups(held: DataFrame, covered: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """The seeds (s, q) that are open in a text, with all holders but the first, which they have been compared with, and the words around each."""
    seeds = stored(held.groupBy("d").agg(F.collect_list(F.struct("p", "s", "q")).alias("seeds"))
                   .join(covered.groupBy("d").agg(F.collect_list(F.struct("a", "b")).alias("found")), "d", "left")
                   .select("d", "seeds", F.coalesce("found", F.array().cast("array<struct<a:int,b:int>>")).alias("found"))
                   .mapInArrow(_seeds_and_cover, "d long, p int, s long, q int, open boolean"), "passage-open-seeds")
    asked = seeds.filter("d <> s").groupBy("s", "q").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("least"), F.max("d").alias("last"), F.bool_or("open").alias("any")).filter(
        "any and least < last").select("s", "q", "n")
    n = F.coalesce(F.when(F.col("d") != F.col("s"), F.col("n")), F.lit(0))
    rows = stored(seeds.join(asked, ["s", "q"], "left").groupBy("d").agg(
        F.collect_list(F.struct("p", "s", "q", "open", n.alias("n"))).alias("seeds"), F.max(n).alias("most")).filter("most > 0").drop("most"), "passage-open-texts")
    around = _taking_part(texts, rows, "d").join(rows, "d").select("d", "t", "seeds").mapInArrow(
        _surroundings(min_words), "s long, q int, n long, d long, p int, open boolean, around binary, near array<long>, paths array<int>")
    # Holders of one seed are dealt to blocks; each open one meets every block.
    around = around.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
    meets = F.expr("""explode(flatten(transform(sequence(0, blocks - 1), j -> if(j = own, array(struct(own as x, own as y, open as asks, true as answers)),
        filter(array(struct(own as x, j as y, open as asks, false as answers), struct(j as x, own as y, false as asks, true as answers)), m -> m.asks or m.answers)))))""")
    return stored(around.select("*", meets.alias("m")).groupBy("s", "q", "m.x", "m.y").agg(F.collect_list(F.struct("d", "p", "m.asks", "m.answers", "around", "near", "paths")).alias("rows")).select(
        "s", "q", "rows"), "passage-open-groups")


def _behind_first(held: DataFrame, pairs: DataFrame, texts: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """Passages (d, a, b, s, x, y, edits) of open seeds and holders behind the first.

    Each open seed is tried with the first holder around which the words may be alike, so that many texts that share a passage cost one pair each;
    a seed that is open after that is tried with all.
    """
    groups = _open_groups(held, _covered(pairs), texts, min_words)
    anchors = "d long, s long, p int, q int"

    def passages(found: DataFrame, name: str) -> DataFrame:
        chained = stored(found.groupBy("d", "s").agg(F.collect_set(F.struct("p", "q")).alias("anchors")).mapInArrow(_chained, CHAIN), name)
        return _passages(chained, _taking_part(texts, chained, "d", "s"), min_words, min_identity)

    one = stored(passages(groups.select("rows").mapInArrow(_around_alike(min_words, min_identity, True), anchors), "passage-open-chains"), "passages")
    asked = groups.select("s", "q", F.explode(F.transform(F.filter("rows", lambda r: r["asks"]), lambda r: F.struct(r["d"].alias("d"), r["p"].alias("p")))).alias("r")).select("s", "q", "r.*").distinct()
    covered = _covered(one).select(F.col("d").alias("own"), "a", "b")
    still = asked.join(covered, (F.col("d") == F.col("own")) & (F.col("a") <= F.col("p")) & (F.col("p") + SEED_WORDS <= F.col("b")), "left_anti")
    still = still.groupBy("s", "q").agg(F.collect_list(F.struct("d", "p")).alias("still"))
    rest = passages(groups.join(still, ["s", "q"]).select("rows", "still").mapInArrow(_around_alike(min_words, min_identity, False), anchors), "passage-open-rest")
    return one.unionByName(rest)


def _taking_part(texts: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Texts whose d stands in one of the columns, and a few whose d shares a bit with one that does: the others need not travel to a join.

    The ids are set in a bitmap of fixed size, so it may be broadcast however many they are.
    """
    bit = F.pmod(F.xxhash64("d"), F.lit(ID_BITS))
    bits = rows.select(F.explode(F.array(*columns)).alias("d")).select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    placed = texts.withColumns({"bucket": F.bitmap_bucket_number(bit), "place": F.bitmap_bit_position(bit)})
    is_set = F.expr("shiftright(cast(conv(hex(substring(bits, cast(place div 8 + 1 as int), 1)), 16, 10) as int), cast(place % 8 as int)) & 1 = 1")
    return placed.join(F.broadcast(bits), "bucket").filter(is_set).select(texts.columns)


def _passages(chained: DataFrame, texts: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """Passages of chains (d, s, p, q): d, a, b, s, x, y, edits."""
    windows = chained.join(texts.withColumnRenamed("d", "s"), "s").select("d", "s", "p", "q", "t").mapInArrow(
        _windows, "d long, s long, p array<int>, q array<int>, begin int, words array<int>")
    # Renamed here as well: only plans that are alike share one shuffle of the texts.
    return windows.join(texts.withColumnRenamed("d", "own"), F.col("d") == F.col("own")).drop("own").mapInArrow(_aligned(min_words, min_identity), "d long, a int, b int, s long, x int, y int, edits int")


def _found(chained: DataFrame, texts: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    return stored(_passages(chained, texts, min_words, min_identity), "passages")


def _covered(pairs: DataFrame) -> DataFrame:
    """The ranges that passages cover in each text."""
    return pairs.select("d", "a", "b").unionByName(pairs.select(F.col("s").alias("d"), F.col("x").alias("a"), F.col("y").alias("b")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """One row per passage and side: doc_id, first_word, end_word, other_id, other_first, other_end, edits. Each match is told from both sides."""
    texts = narrow(docs, d=id_col, t=text_col).select(F.col("d").cast("long").alias("d"), "t").filter("d is not null and t is not null")
    held = stored(_held(texts.mapInArrow(_seeds, "h long, d long, p int")), "passage-seeds")
    chained = stored(_anchors(held).mapInArrow(_chained, CHAIN), "passage-chains")
    pairs = _found(chained, _taking_part(texts, chained, "d", "s"), min_words, min_identity)
    # First holders may hold parts only of what later texts share. What no passage covers yet is matched by n-grams as long as a passage.
    known = held.groupBy("d").agg(F.collect_list("p").alias("held")).join(_covered(pairs).groupBy("d").agg(F.collect_list(F.struct("a", "b")).alias("found")), "d", "left")
    ranges = stored(known.select("d", "held", "found").mapInArrow(_open_ranges(min_words), "d long, a int, b int").groupBy("d").agg(
        F.collect_list(F.struct("a", "b")).alias("ranges")), "passage-ranges")
    long_seeds = stored(_taking_part(texts, ranges, "d").join(ranges, "d").select("d", "t", "ranges").mapInArrow(_long_seeds(min_words), "h long, d long, p int"), "passage-long-seeds")
    chained = stored(_anchors(_held(long_seeds)).mapInArrow(_runs(min_words), CHAIN), "passage-runs")
    more = _found(chained, _taking_part(texts, chained, "d", "s"), min_words, min_identity)
    side = ["d", "a", "b", "s", "x", "y"]
    pairs = pairs.unionByName(more.distinct().join(pairs, side, "left_anti").select(pairs.columns))
    # Edited passages that no first holder has: the seeds that are open yet meet their other holders.
    rest = _behind_first(held, pairs, texts, min_words, min_identity).distinct().join(pairs, side, "left_anti").select(pairs.columns)
    sides = pairs.unionByName(rest).select(F.explode(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(order, ("doc_id", "first_word", "end_word", "other_id", "other_first", "other_end", "edits"))])
                                             for order in (("d", "a", "b", "s", "x", "y", "edits"), ("s", "x", "y", "d", "a", "b", "edits"))])).alias("r"))
    return sides.select("r.*")
