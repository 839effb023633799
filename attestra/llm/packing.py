"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document's ids, and one separator, are cut only where they exceed a sequence:
every piece but the first is then a full sequence.  The lengths of all pieces
form a histogram of at most ``capacity`` bins, the only thing that reaches the
driver.  There a configuration linear program (how often to use each multiset of
lengths that fits) is solved by multiplicative weights: a knapsack dynamic
program prices the best filling of every remainder, each length takes its column,
and prices fall with coverage.  The fractional solution is rounded down, its
fractional columns are used while their lengths last, and what is left goes
best-fit decreasing.  Pieces find their slot by their rank within their length,
counted in two levels, so that no length meets in one task.

Defined results: null text is the empty text, a piece of one separator; repeated
rows are packed once per row; an empty table packs to no rows; extra columns are
ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, keep_small, only, worker_cache

CAPACITY = 2048
SEPARATOR = 0
TOKENIZER = "byte_bpe_50k.json"
#: Rounds of multiplicative weights; with the capacity it bounds the number of columns.
ROUNDS = 24
#: Words whose ids a Python worker remembers.
WORDS = 250_000
#: Texts whose new words are encoded together.
TOGETHER = 250
#: The last letter up to which all Unicode tables agree on what is a letter; characters that not all call white space.
LATIN = "\u024f"
ODD = re.compile("[\x00\x1c-\x1f\x85\u180e]")
SPACED = re.compile(r" (?:\s|$)")
WITHIN = re.compile(r".\s", re.DOTALL)


def _merger(path: str):
    """The tokenizer's merges run by tiktoken, which is several times faster; None where the two might differ.

    Both merge the pair of the lowest rank, but tiktoken takes any two neighbours that make
    up a token.  Where ranks follow the ids and every token, encoded alone, is itself, no
    other neighbours can make it up: what stands within its bounds has been merged as it
    would be alone.
    """
    from public_tokenizers import PATTERN
    from tiktoken import Encoding
    from tokenizers import Tokenizer, pre_tokenizers

    model, tokenizer = json.loads(Path(path).read_text())["model"], Tokenizer.from_file(path)
    ids = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    alone = all(len(tokenizer.model.tokenize(token)) == 1 for token in model["vocab"])
    if not alone or ids != sorted(set(ids)):
        return None
    # The byte that each of the alphabet's characters stands for: the byte-level step writes those of a text in place of its bytes.
    text = "".join(map(chr, range(0x800)))
    shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0]
    byte = dict(zip(shown, text.encode()))
    byte |= {c: k for c, k in zip(sorted(set(pre_tokenizers.ByteLevel.alphabet()) - byte.keys()), sorted(set(range(256)) - set(byte.values())))}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if byte.keys() >= set(token)}
    return Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of whole texts, from the words that the tokenizer never joins.

    It never joins what stands before a space to what follows it, if that is no white
    space.  Such words repeat, so their ids are remembered; new ones are encoded
    together, set apart by line feeds, but for those that hold white space within.  Texts
    and words for which Unicode tables might differ go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = _merger(path)
        self.words: dict[str, bytes] = {"": b""}
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _merge(self, text: str) -> np.ndarray:
        return self._encode(text) if self.merger is None else np.array(self.merger.encode_ordinary(text), dtype="<u4")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        known = {w: self._encode(w).tobytes() for w in words if not w.isascii() and max(w) > LATIN or "<|" in w or ODD.search(w)}
        known |= {w: self._merge(w).tobytes() for w in words if (WITHIN.search(w) or w.isspace()) and w not in known}
        joined = [w for w in words if w not in known]
        if joined:
            ids = self._merge("\n".join(joined))
            ends = [*np.flatnonzero(ids == self.line_feed), len(ids)]
            at, raw = 0, ids.tobytes()
            for w, end in zip(joined, ends, strict=True):
                known[w] = raw[4 * at : 4 * end]
                at = end + 1
        if len(self.words) < WORDS:
            self.words.update(known)
        return known

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(texts), TOGETHER):
            split = list(map(self._words, texts[at : at + TOGETHER]))
            known = self.words
            new = {w for words in split for w in words if w not in known}
            learnt = self._learn(list(new)) if new else {}
            if new and len(known) >= WORDS:
                get = known.get
                out += [b"".join([get(w) or learnt[w] if w else b"" for w in words]) for words in split]
            else:
                out += [b"".join([known[w] for w in words]) for words in split]
        return out

    def _words(self, text: str) -> list[str]:
        """Parts of the text, each word with the space before it, that can be encoded one by one."""
        if "<|endoftext|>" in text or "\0" in text or ODD.search(text):
            return [text]
        words = text.replace(" ", "\0 ").split("\0")
        # A part that is empty or begins with white space belongs to what stands before it.
        return _joined(words) if SPACED.search(text) else words


def _joined(words: list[str]) -> list[str]:
    parts = words[:1]
    for word in words[1:]:
        if len(word) > 1 and not word[1].isspace():
            parts.append(word)
        else:
            parts[-1] += word
    return parts


_encoders: dict[str, Encoder] = worker_cache()


def _encoder(path: str) -> Encoder:
    """The worker's own, from task to task: a function within another would be sent with an empty dict of its own."""
    only(_encoders)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's pieces."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_path)
        end = np.array([SEPARATOR], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].tolist(), encoder.batch(batch["text"].fillna("").tolist())):
                ids += end
                n = len(ids) // 4
                at, stop = 0, (n - 1) % capacity + 1
                piece = 0
                while at < n:
                    own = ids[4 * at : 4 * stop]
                    row = (doc_id, piece, at, stop - at, zlib.crc32(own))
                    rows.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if with_ids else row)
                    at, stop, piece = stop, stop + capacity, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def _fillings(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[w]: the highest price of lengths that fit in w; last[w]: one of them, 0 for none."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for w in range(1, capacity + 1):
        total = prices[1 : w + 1] + best[w - 1 :: -1][:w]
        k = int(total.argmax())
        if total[k] > best[w - 1]:
            best[w], last[w] = total[k], k + 1
        else:
            best[w], last[w] = best[w - 1], -1
    return best, last


def _filling(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0 and last[room]:
        if last[room] < 0:
            room -= 1
            continue
        out.append(int(last[room]))
        room -= out[-1]
    return out


def solve(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), together exactly ``counts``."""
    demand = np.zeros(capacity + 1)
    for length, n in counts.items():
        demand[length] = n
    present = np.flatnonzero(demand)
    left = Counter({int(k): int(demand[k]) for k in present})
    if not len(present):
        return []
    prices = np.full(capacity + 1, -np.inf)
    prices[present] = present / capacity
    covered = np.zeros(capacity + 1)
    columns: dict[tuple[int, ...], float] = defaultdict(float)
    for _ in range(rounds):
        best, last = _fillings(prices, capacity)
        for length in present[::-1]:
            length = int(length)
            # what this length still lacks of its share of the rounds so far
            lack = demand[length] * (_ + 1) / rounds - covered[length]
            if lack <= 0:
                continue
            column = Counter(_filling(last, capacity - length))
            column[length] += 1
            amount = min(lack / column[length], min(max(demand[k], 1) / n for k, n in column.items()))
            columns[tuple(sorted(column.elements(), reverse=True))] += amount
            for k, n in column.items():
                covered[k] += n * amount
        ratio = covered[present] / demand[present] - (_ + 1) / rounds
        prices[present] *= np.exp(-2.0 * np.clip(ratio, -1, 1))
        prices[present] = np.minimum(prices[present] / best[capacity], 1.0)
    out: list[tuple[tuple[int, ...], int]] = []

    def use(column: tuple[int, ...], times: int) -> None:
        need = Counter(column)
        times = min(times, *(left[k] // n for k, n in need.items())) if need else 0
        if times > 0:
            out.append((column, times))
            for k, n in need.items():
                left[k] -= n * times

    order = sorted(columns.items(), key=lambda c: (-sum(c[0]), c[0]))
    for column, amount in order:
        use(column, int(amount))
    for column, amount in sorted(order, key=lambda c: (-sum(c[0]) // 16, -(c[1] % 1), c[0])):
        use(column, 1)
    return _merged(out + best_fit(left, capacity))


def best_fit(left: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal sequences are kept together."""
    by_room: dict[int, Counter] = defaultdict(Counter)
    for length in sorted((k for k, n in left.items() if n > 0), reverse=True):
        n = left[length]
        for room in sorted(r for r in by_room if r >= length):
            if not n:
                break
            each = room // length
            for column, times in list(by_room[room].items()):
                take = min(times, n // each) if n >= each else 0
                if take:
                    by_room[room][column] -= take
                    by_room[room - each * length][column + (length,) * each] += take
                    n -= take * each
                if n and n < each and times > take:
                    by_room[room][column] -= 1
                    by_room[room - n * length][column + (length,) * n] += 1
                    n = 0
                by_room[room] = +by_room[room]
                if not n:
                    break
        if n:
            each = capacity // length
            full, rest = divmod(n, each)
            if full:
                by_room[capacity - each * length][(length,) * each] += full
            if rest:
                by_room[capacity - rest * length][(length,) * rest] += 1
    return [(column, times) for room in by_room.values() for column, times in room.items() if times > 0]


def _merged(columns: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    total: Counter = Counter()
    for column, times in columns:
        total[tuple(sorted(column, reverse=True))] += times
    return sorted(total.items(), key=lambda c: (-c[0][0], c[0]))


def slots(columns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows of length, first rank, first sequence, pieces a sequence, offset - by length and rank."""
    rows, used, sequence = [], Counter(), 0
    for column, times in columns:
        at = 0
        for length, n in Counter(column).items():
            rows.append((length, used[length], sequence, n, at))
            used[length] += n * times
            at += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    cut = keep(pieces(docs, tokenizer_path, capacity, with_ids), "pack-pieces")
    # Rank within the length: bucket by bucket, then within the bucket.
    buckets = 1 << max(0, math.ceil(math.log2(max(cut.count(), 1)) / 2))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    per = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    per = keep_small(per, "pack-counts")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = docs.sparkSession.sparkContext.broadcast(slots(solve(counts, capacity)))
    so_far = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("within", F.row_number().over(within) - 1).join(per.select("length", "bucket", "base"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("within"))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = table.value
        length, rank = length.to_numpy(), rank.to_numpy()
        row = t[np.searchsorted((t[:, 0] << 44) + t[:, 1], (length << 44) + rank, side="right") - 1]
        k = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + k // row[:, 3], "offset": row[:, 4] + k % row[:, 3] * length})

    placed = ranked.withColumn("at", slot("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from ``pack(..., with_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("input_ids"))
