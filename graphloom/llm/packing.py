"""Filling fixed-capacity containers with texts, best-two-fit.

Texts are measured in tokens of a public tokenizer. A text larger than the capacity is cut into full containers and a
remainder; all remainders and smaller texts are packed. Packing runs in shards of about ``per_shard`` texts that a hash
of the id draws at random, so that every shard sees the whole mix of sizes, and each shard wastes at most its last,
partly filled container besides the usual slack. Only ids and sizes are shuffled, never texts.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: fixed value: the published pre-tokenisation pattern of this vocabulary family
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tiktoken encoding whose ranks ``path`` holds; loaded once a worker."""
    if path not in _loaded:
        import tiktoken

        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        _loaded[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_sizes(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (id, tokens) of the texts that have tokens; null and empty texts are left out, whole texts are measured."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "tokens": [len(enc.encode_ordinary(t)) for t in b["t"]]})

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).where(F.length("t") > 0)
    return rows.mapInPandas(measure, "id long, tokens long")


class Stock:
    """Unpacked items by size: the sizes present in ascending order, the items of each size, first in first out."""

    def __init__(self, sizes: list[int]):
        self.items: dict[int, list[int]] = {}
        for i in range(len(sizes) - 1, -1, -1):
            self.items.setdefault(sizes[i], []).append(i)
        self.sizes = sorted(self.items)

    def largest(self, most: int, spare: int = 0) -> int:
        """The largest size of at most ``most`` of which more than ``spare`` items are left; 0 if none."""
        k = bisect_right(self.sizes, most) - 1
        return self.sizes[k] if k >= 0 else 0

    def take(self, size: int) -> int:
        have = self.items[size]
        i = have.pop()
        if not have:
            del self.items[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]
        return i

    def put(self, size: int, item: int) -> None:
        if size not in self.items:
            self.sizes.insert(bisect_right(self.sizes, size), size)
            self.items[size] = []
        self.items[size].append(item)

    def best_two(self, more_than: int, most: int) -> tuple[int, int] | None:
        """The sizes of two items whose sum is as large as can be, above ``more_than`` and at most ``most``."""
        lo, hi, best, pair = 0, bisect_right(self.sizes, most) - 1, more_than, None
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > most or (lo == hi and len(self.items[a]) < 2):
                hi -= 1
                continue
            if a + b > best:
                best, pair = a + b, (a, b)
                if best == most:
                    break
            lo += 1
        return pair


def best_two_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item. Each size is from 1 to ``capacity``.

    A bin is filled with the largest items that still fit; then its smallest item is put back in exchange for the two
    unpacked items that fill the gap it leaves best, if they leave less, and filling goes on.
    """
    stock, bins, b = Stock(sizes), [0] * len(sizes), 0
    while stock.sizes:
        held: list[tuple[int, int]] = []
        gap = capacity
        while True:
            while gap and (s := stock.largest(gap)):
                held.append((s, stock.take(s)))
                gap -= s
            if not gap or not stock.sizes:
                break
            small = min(range(len(held)), key=lambda i: held[i][0])
            size, item = held[small]
            pair = stock.best_two(size, size + gap)
            if pair is None:
                break
            del held[small]
            held += [(s, stock.take(s)) for s in pair]
            gap += size - sum(pair)
            stock.put(size, item)
        for _, i in held:
            bins[i] = b
        b += 1
    return bins


def pack(sizes: DataFrame, capacities: DataFrame, per_shard: int = 20_000) -> DataFrame:
    """Rows (budget_name, capacity, container, id, piece, start, tokens): where each piece of each text lies.

    ``sizes`` is (id, tokens), ``capacities`` (budget_name, capacity_tokens). ``start`` is the piece's first token in
    its text. Texts of no tokens and capacities that are null or below 1 get no rows; an id that is repeated is packed
    as often as it occurs. ``container`` names are unique over shards and budgets.
    """
    spark = sizes.sparkSession
    budgets = [(r["budget_name"], r["capacity_tokens"]) for r in capacities.select("budget_name", "capacity_tokens").distinct().collect() if r["capacity_tokens"] and r["capacity_tokens"] > 0]
    schema = "budget_name string, capacity long, container string, id long, piece long, start long, tokens long"
    if not budgets:
        return spark.createDataFrame([], schema)
    # a text is drawn to the shard (hash, of size classes) once its number is known; the count is one cheap pass
    shards = max(1, round(sizes.select("id").count() / per_shard))
    plan = F.array(*[F.struct(F.lit(n).alias("budget_name"), F.lit(int(c)).cast("long").alias("capacity")) for n, c in budgets])
    # repeated ids get numbers, so that their containers have names of their own
    copies = sizes.where(F.col("tokens") > 0).groupBy("id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    single = copies.select("id", "tokens", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    rows = single.select("id", "tokens", "copy", F.pmod(F.xxhash64("id", "tokens", "copy"), F.lit(shards)).cast("int").alias("shard"), F.explode(plan).alias("b")).select("id", "tokens", "copy", "shard", "b.*")
    size = F.col("capacity")
    whole = F.floor(F.col("tokens") / size)
    full = rows.where(F.col("tokens") >= size).select("budget_name", "capacity", "id", "copy", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece")).select(
        "budget_name", "capacity", F.concat_ws("/", "budget_name", F.lit("whole"), "id", "piece", F.when(F.col("copy") > 1, F.col("copy").cast("string"))).alias("container"), "id", F.col("piece").cast("long").alias("piece"), (F.col("piece") * size).alias("start"), size.alias("tokens")
    )
    rest = rows.select("budget_name", "capacity", "shard", "id", whole.cast("long").alias("piece"), (whole * size).cast("long").alias("start"), (F.col("tokens") - whole * size).cast("long").alias("tokens")).where(F.col("tokens") > 0)

    def fill(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["tokens", "id", "piece"], ascending=[False, True, True], ignore_index=True)
        name, cap, shard = p["budget_name"][0], int(p["capacity"][0]), p["shard"][0]
        at = best_two_fit(p["tokens"].tolist(), cap)
        p["container"] = [f"{name}/{shard}/{b}" for b in at]
        return p[["budget_name", "capacity", "container", "id", "piece", "start", "tokens"]]

    return full.unionByName(rest.groupBy("budget_name", "capacity", "shard").applyInPandas(fill, schema))
