"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may differ from a passage by k = floor(rate * n) word edits. Cut into k + 1 pieces, at least one piece is
in the passage unchanged. Tasks look for the pieces' hashes at every word of every text, and verify each hit with Myers'
bit-parallel distance on the words around it. Texts are never shuffled; the items travel to the tasks in blocks of bounded
size, each of which is matched with all texts.

Words are runs of letters and digits in lower case. Null or empty texts match nothing. Items that are null or shorter than
min_words match nothing. Equal items each match. Rows with equal ids are matched one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from factloom.llm.store import narrow
from factloom.llm.words import Piece, Scanner

EDIT_RATE = 0.15
MIN_WORDS = 5
# Text bytes of the items in one block. Every task holds one block at a time.
BLOCK_BYTES = 16 << 20
FILTER_BITS = 20


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    edits: int


@dataclass
class Pieces:
    """The pieces of one length: sorted hashes with the item and the place each comes from."""
    length: int
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray


class Block:
    """Items of one block with their pieces."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = EDIT_RATE, min_words: int = MIN_WORDS):
        self.items, found = [], {}
        for piece in Scanner(True).pieces(pc.utf8_lower(pa.array([t or "" for _, t in rows], pa.string()))):
            for row in range(len(piece)):
                words = piece.hashes[piece.rows[row]: piece.rows[row + 1]]
                if len(words) < max(1, min_words):
                    continue
                item = Item(rows[piece.first + row][0], words, int(rate * len(words)))
                cuts = np.linspace(0, len(words), item.edits + 2).astype(int)
                for a, b in zip(cuts[:-1], cuts[1:]):
                    found.setdefault(int(b - a), []).append((_hash(words[a:b]), len(self.items), int(a)))
                self.items.append(item)
        self.pieces = []
        for length, rows_ in sorted(found.items()):
            rows_.sort()
            hashes, items, places = zip(*rows_)
            self.pieces.append(Pieces(length, np.array(hashes, np.uint64), np.array(items), np.array(places)))

    def matches(self, piece: Piece) -> Iterator[tuple[int, Item, int, int, int]]:
        """Row, item, edits, first and last + 1 word of the best match of each item in each text."""
        near: dict[tuple[int, int], set[int]] = {}
        row_of = piece.row_of_word()
        for part in self.pieces:
            grams, inside = piece.ngrams(part.length)
            mask = np.zeros(1 << FILTER_BITS, bool)
            mask[part.hashes & np.uint64((1 << FILTER_BITS) - 1)] = True
            at = np.flatnonzero(mask[grams & np.uint64((1 << FILTER_BITS) - 1)] & inside)
            low = np.searchsorted(part.hashes, grams[at], "left")
            high = np.searchsorted(part.hashes, grams[at], "right")
            for word, a, b in zip(at[low < high], low[low < high], high[low < high]):
                row = int(row_of[word])
                for k in range(a, b):
                    near.setdefault((row, int(part.items[k])), set()).add(int(word - part.places[k] - piece.rows[row]))
        for (row, k), begins in sorted(near.items()):
            item, best, done = self.items[k], None, None
            text = piece.hashes[piece.rows[row]: piece.rows[row + 1]]
            for begin in sorted(begins):
                # Windows of hits so close together are one window.
                if done is not None and begin + len(item.words) + item.edits <= done:
                    continue
                a, done = max(0, begin - item.edits), begin + len(item.words) + 2 * item.edits
                hit = best_match(item.words, text[a:done], item.edits)
                if hit is not None and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1], a + hit[2])
            if best is not None:
                yield piece.first + row, item, *best


def _hash(words: np.ndarray) -> int:
    whole = Piece(0, None, np.array([0, 1]), words, words, words, np.array([0, len(words)]))
    return int(whole.ngrams(len(words))[0][0])


def myers(pattern: list[int], text: list[int]) -> Iterator[int]:
    """Least edits between the pattern and any part of the text that ends at each word (bit-parallel, semi-global)."""
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    places: dict[int, int] = {}
    for k, word in enumerate(pattern):
        places[word] = places.get(word, 0) | 1 << k
    plus, minus, score = full, 0, size
    for word in text:
        same = places.get(word, 0)
        across = same | minus
        down = (((same & plus) + plus) ^ plus) | same
        more, less = minus | (full & ~(down | plus)), plus & down
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        plus, minus = less | (full & ~(across | more)), more & across
        yield score


def best_match(words: np.ndarray, text: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """Edits, first and last + 1 word of the closest part of the text; None beyond the budget. The earliest end wins ties."""
    pattern, text = [int(w) for w in words], [int(w) for w in text]
    scores = list(myers(pattern, text))
    if not scores or min(scores) > edits:
        return None
    least = min(scores)
    end = scores.index(least) + 1
    back = list(myers(pattern[::-1], text[:end][::-1]))
    return least, end - (back.index(least) + 1), end


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", rate: float = EDIT_RATE,
           min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of bounded size, read one partition at a time."""
    rows, size = [], 0
    for item_id, text in narrow(benchmark, i=item_col, t=text_col).filter("t is not null").toLocalIterator():
        if rows and size + len(text) > block_bytes:
            yield Block(rows, rate, min_words)
            rows, size = [], 0
        rows.append((item_id, text))
        size += len(text)
    if rows:
        yield Block(rows, rate, min_words)


def _found(scanner: Scanner, block: Block, texts: pa.Array) -> Iterator[tuple[int, Item, int, int, int]]:
    for piece in scanner.pieces(pc.utf8_lower(pc.fill_null(texts, ""))):
        yield from block.matches(piece)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", rate: float = EDIT_RATE, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item in it: doc_id, item_id, edits, item_words, first_word, end_word (exclusive)."""
    schema = "doc_id long, item_id long, edits int, item_words int, first_word int, end_word int"
    texts = narrow(docs, d=id_col, t=text_col)
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, item_col, item_text_col, rate, min_words, block_bytes):
        out = out.unionByName(texts.mapInArrow(_finder(block), schema))
    return out


def _finder(block: Block):
    def find_in(batches):
        scanner = Scanner(True)
        for batch in batches:
            hits = list(_found(scanner, block, batch["t"]))
            rows, items, edits, first, end = zip(*hits) if hits else [()] * 5
            yield pa.record_batch({
                "doc_id": batch["d"].take(pa.array(rows, pa.int64())).cast(pa.int64()),
                "item_id": pa.array([i.item_id for i in items], pa.int64()), "edits": pa.array(edits, pa.int32()),
                "item_words": pa.array([len(i.words) for i in items], pa.int32()),
                "first_word": pa.array(first, pa.int32()), "end_word": pa.array(end, pa.int32()),
            })

    return find_in


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of documents in whose text no item is found, with all their columns; nothing is shuffled."""
    for block in blocks(benchmark, **options):
        docs = docs.mapInArrow(_dropper(block, text_col), docs.schema)
    return docs


def _dropper(block: Block, text_col: str):
    def drop(batches):
        scanner = Scanner(True)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, *_ in _found(scanner, block, batch.column(batch.schema.get_field_index(text_col))):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return drop


def contaminated_ids(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))
