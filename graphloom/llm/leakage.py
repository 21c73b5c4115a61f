"""Evaluation texts that leaked into a corpus, by latent semantic retrieval and alignment.

1. Texts become words: lower case, without markup, escapes, entities and punctuation. A sentence with which many distinct
   items begin, to go on differently (a standing instruction), is taken out of them.
2. Every document is read once and becomes the numbers of the items' words in it; all further steps work on those.
   Documents are cut into overlapping passages. Over the passages of all distinct texts the document frequencies of the
   items' words are counted; a word of more than ``max_df`` of them has no weight, the others have tf-idf weights.
   Passages without any weight have no direction; they go on if they hold a seed (step 5) or an answer of an item.
3. A randomised SVD of passages and item windows: a random sketch, one power iteration and Rayleigh-Ritz, each a sum of
   small matrices (words x rank), one for each task of a number of tasks that the cores give, not the data.
4. Every passage is compared with every item window by cosine in the latent space; pairs above a threshold, which is
   fitted to shortened and disturbed windows of the items themselves, are candidates. None are cut off.
5. A leak has at least ``least`` consecutive item words, or the whole item, with at most one word in ``tolerance``
   changed, added or left out. It always holds some words of the item in a row (a seed), so every passage is aligned word
   by word with the items whose seeds it holds, whatever their weights. Other candidates may count as paraphrases by
   their longest common subsequence and the item's answer; so may passages, or items with windows, that have no weight.

Items are taken in blocks of ``block`` items, so that what is sent to the executors is bounded.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.registry import shared_dir, slots

WORD = re.compile(r"[^\W_]+")
SPECIAL = re.compile(r"[\\&<%­​-‏⁠﻿]|[^\x00-ɏ]")
ESCAPE = re.compile(r"\\+(?:[nrtfvb0](?![A-Za-z]*\\)|[nrt]|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2}))")
TAGS = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->|<br\s*/?>", re.S)
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
HIDDEN = re.compile("[­​-‏⁠﻿]")

PLAIN = "".join(chr(k).lower() if chr(k).isalnum() else " " for k in range(128))


def _escaped(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code and not 0xD800 <= int(code, 16) <= 0xDFFF else " "


def words_of(text: str) -> list[str]:
    """The words of a text, lower case, without markup and escapes."""
    if SPECIAL.search(text):
        if "\\" in text:
            text = ESCAPE.sub(_escaped, text).replace("\\", "")
        if "%" in text:
            text = PERCENT.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)
        if "&" in text:
            text = html.unescape(text)
        if "<" in text:
            text = TAGS.sub(lambda m: " " if m[0][1:3].lower() in ("br", "p>", "/p", "li", "/l", "di", "/d", "td", "tr", "h1", "h2", "h3") else "", text)
        text = unicodedata.normalize("NFKC", HIDDEN.sub("", text))
    if text.isascii():
        return text.translate(PLAIN).split()
    return WORD.findall(text.lower())


def _sentences(text: str) -> list[tuple[str, ...]]:
    return [w for s in re.split(r"(?<=[.!?:])\s+|\n+", text) if (w := tuple(words_of(s)))]


def standing_sentences(texts: DataFrame, share: float = 0.02, least: int = 3) -> set[tuple[str, ...]]:
    """Sentences, as words, with which at least ``share`` of the distinct texts, and ``least`` of them, begin and go on differently.

    ``texts`` has a column ``t``. Copies count once, and so do texts that are the same as far as the next sentence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [[" ".join(w) for w in s] for t in b["t"] if (s := _sentences(t))]
            yield pd.DataFrame([(s[0], s[1] if len(s) > 1 else None, " ".join(s[1:])) for s in cut], columns=["first", "then", "rest"])

    known = texts.select("t").mapInPandas(run, "first string, then string, rest string").distinct()
    counts = known.groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("then").alias("ways"))
    common = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).where(F.col("ways") >= F.greatest(F.lit(least), share * F.col("all")))
    return {w for r in common.select("first").collect() if len(w := tuple(r["first"].split(" "))) >= 4}  # at most 1 / share, or a least-th of few texts


def item_words(text: str, standing: set[tuple[str, ...]]) -> list[str]:
    """The words of an item without the standing sentence it begins with, if there is more to it."""
    sentences = _sentences(text)
    skip = 1 if len(sentences) > 1 and sentences[0] in standing else 0
    return [w for s in sentences[skip:] for w in s]


def windows(n: int, length: int, stride: int) -> list[tuple[int, int]]:
    """Overlapping spans that cover n words; the last one ends with them."""
    if n <= length:
        return [(0, n)] if n else []
    starts = list(range(0, n - length, stride)) + [n - length]
    return [(s, s + length) for s in starts]


# ---------------------------------------------------------------- alignment
def _reach(a: Sequence, b: Sequence, errors: int) -> list[int]:
    """How many words of ``a`` can be covered from its start, against ``b`` from its start, with 0, 1, ... errors."""
    n, m = len(a), len(b)
    out = [0] * (errors + 1)
    front = {0: 0}
    for e in range(errors + 1):
        if e:
            nxt: dict[int, int] = {}
            for d, i in front.items():  # d = place in b - place in a
                for nd, ni in ((d, i + 1), (d + 1, i), (d - 1, i + 1)):  # changed, added, left out
                    if ni <= n and 0 <= ni + nd <= m and nxt.get(nd, -1) < ni:
                        nxt[nd] = ni
            for d, i in front.items():
                if nxt.get(d, -1) < i:
                    nxt[d] = i
            front = nxt
        best = out[e - 1] if e else 0
        for d, i in front.items():
            at, j = i, i + d
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            front[d] = i
            if i > at:  # a span ends with a word that is right
                best = max(best, i)
        out[e] = best
    return out


def seed_length(n: int, tolerance: int = 8, seed: int = 5) -> int:
    """How many words in a row any leak of an item of n words holds: two halves of a short item may be too short for ``seed``."""
    return min(seed, n if n < tolerance else n // 2)


def aligned(item: Sequence, grams: dict[tuple, list[int]], passage: Sequence, least: int = 12, tolerance: int = 8, seed: int = 5, errors: int = 4) -> bool:
    """Whether a passage holds the whole item or ``least`` consecutive words of it, one word in ``tolerance`` being off.

    Such a span always holds ``seed_length`` words in a row; from each such place it is extended both ways. A span of
    a longer item ends with words that are right; of an item of at most ``least`` words its first or last may be off.
    """
    n, m = len(item), len(passage)
    need = min(least, n)
    seed = seed_length(n, tolerance, seed)
    done: set[tuple[int, int]] = set()
    for j in range(m - seed + 1):
        for i in grams.get(tuple(passage[j : j + seed]), ()):
            if (i - j, j) in done:
                continue
            end = seed
            while i + end < n and j + end < m and item[i + end] == passage[j + end]:
                end += 1
            done.update((i - j, k) for k in range(j, j + end))
            right = _reach(item[i + end : i + end + 60], passage[j + end :], errors)
            left = _reach(item[:i][::-1][:60], passage[:j][::-1], errors)
            for e1, left_len in enumerate(left):
                for e2 in range(errors + 1 - e1):
                    span = left_len + end + right[e2]
                    if span >= need and (e1 + e2) * tolerance <= span:
                        return True
                    if n <= least and (e1 + e2 + max(0, n - span)) * tolerance <= n:
                        return True
    return False


def common_share(item: Sequence, passage: Sequence) -> float:
    """The longest common subsequence's share of the shorter text."""
    if not item or not passage:
        return 0.0
    at = {w: 0 for w in passage}
    masks = dict.fromkeys(at, 0)
    for k, w in enumerate(passage):
        masks[w] |= 1 << k
    full = (1 << len(passage)) - 1
    v = full
    for w in item:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return (len(passage) - v.bit_count()) / min(len(item), len(passage))


# ---------------------------------------------------------------- retrieval
TERMS = 16  # rows of a matrix that are sent together


def _pieces(m: np.ndarray) -> pd.DataFrame:
    """A matrix as (k, m) rows of ``TERMS`` of its rows each, without those of zeros."""
    full = np.zeros((-(-len(m) // TERMS) * TERMS, m.shape[1]), np.float32)
    full[: len(m)] = m
    parts = full.reshape(-1, TERMS * m.shape[1])
    at = np.flatnonzero(parts.any(axis=1))
    return pd.DataFrame({"k": at.astype(np.int32), "m": [parts[k].tobytes() for k in at]})


def _sum_matrices(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices given in ``_pieces``: as much comes to the driver as one matrix has."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b["k"].tolist(), b["m"], strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.float32).astype(np.float64)
        yield pd.DataFrame({"k": list(total), "m": [x.astype(np.float32).tobytes() for x in total.values()]})

    blocks = -(-shape[0] // TERMS)
    out = np.zeros((blocks, TERMS * shape[1]))
    for r in parts.repartition(max(1, min(64, blocks // 8)), "k").mapInPandas(add, "k int, m binary").collect():  # as many rows as blocks
        out[r["k"]] = np.frombuffer(r["m"], np.float32)
    return out.reshape(blocks * TERMS, shape[1])[: shape[0]]


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n terms in a row."""
    out = np.zeros(max(0, len(ids) - n + 1), np.int64)
    for k in range(n):
        out = out * 1_000_003 + ids[k : len(ids) - n + 1 + k]
    return out


def _hits(ids: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """At which places n terms in a row have a hash in the sorted, non-empty ``known``; -1 is no term."""
    out = np.zeros(max(0, len(ids) - n + 1), bool)
    at = np.flatnonzero(ids >= 0)
    at = at[: max(0, len(at) - n + 1)][at[n - 1 :] - at[: max(0, len(at) - n + 1)] == n - 1]
    if len(at):
        x = _hashes(ids, n)[at]
        out[at] = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
    return out


def _rows(ids: Sequence[Sequence[int]], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of tf-idf rows of unit length; terms repeat as often as they occur."""
    sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids))
    row = np.repeat(np.arange(len(ids)), sizes)
    term = np.concatenate([np.asarray(x, np.int64) for x in ids]) if len(ids) else np.zeros(0, np.int64)
    w = idf[term]
    dense_norm = np.zeros(len(ids))
    key = row * len(idf) + term
    u, count = np.unique(key, return_counts=True)
    urow, uterm = u // len(idf), u % len(idf)
    uw = idf[uterm] * (1 + np.log(count))
    np.add.at(dense_norm, urow, uw * uw)
    del w, row, term
    return urow, uterm, uw / np.sqrt(np.maximum(dense_norm[urow], 1e-12))


def _latent(ids: Sequence[Sequence[int]], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    row, term, w = _rows(ids, idf)
    out = np.zeros((len(ids), basis.shape[1]), np.float32)
    if len(row):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[starts]] = np.add.reduceat(basis[term] * w[:, None].astype(np.float32), starts, axis=0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", answers: str | None = "expected_symbols",
    least: int = 12, tolerance: int = 8, length: int = 32, stride: int = 16, margin: int = 8, max_df: float = 0.02, rank: int = 256, block: int = 5000, seed: int = 11,
) -> DataFrame:
    """Rows (item_id, doc_id, kind): kind ``passage`` where a document holds an item as ``aligned`` says, ``paraphrase``
    where only the longest common subsequence and all the item's answers speak for it.

    Documents and items of null or empty text give no rows; an item that is nothing but a standing sentence keeps it.
    Items that repeat under several ids come out under each. One row for each pair and kind.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    cols = [F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t"), *([F.col(f"`{answers}`").alias("a")] if answers else [])]
    known = items.where(F.length(item_text) > 0).select(*cols)
    standing = standing_sentences(known)
    corpus = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{doc_text}`").alias("t")).where(F.length("t") > 0)
    out, held = None, []

    def flush() -> None:
        nonlocal out, held
        if held:
            found = _leaks_of(corpus, held, least, tolerance, length, stride, margin, max_df, rank, seed)
            out = found if out is None else out.unionByName(found)
            held = []

    for r in known.orderBy("i").toLocalIterator():
        words = item_words(r["t"], standing)
        if words:
            held.append((r["i"], words, sorted({w for x in (r["a"] or []) if x for w in words_of(x)}) if answers else []))
        if len(held) == block:
            flush()
    flush()
    empty = spark.createDataFrame([], "item_id long, doc_id long, kind string")
    return empty if out is None else out.distinct()


def _leaks_of(corpus: DataFrame, held: list, least: int, tolerance: int, length: int, stride: int, margin: int, max_df: float, rank: int, seed: int) -> DataFrame:
    spark = corpus.sparkSession
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws, _ in held for w in ws}))}
    size = len(vocabulary)
    for w in sorted({w for _, _, answer in held for w in answer}):  # words of answers have numbers, but no weight
        vocabulary.setdefault(w, len(vocabulary))
    number = np.int16 if len(vocabulary) < 1 << 15 else np.int32
    get = vocabulary.get

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["d"], b["t"], strict=True):
                words = words_of(t)
                ids = np.array([get(w, -1) for w in words], number)
                rows.append((d, hashlib.md5(t.encode(), usedforsecurity=False).digest(), len(ids), ids.tobytes() if (ids >= 0).any() else b""))
            yield pd.DataFrame(rows, columns=["d", "h", "n", "ids"])

    coded = corpus.mapInPandas(code, "d long, h binary, n int, ids binary").checkpoint()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, passages = np.zeros(size + 1, np.int64), 0
        for b in batches:
            keys, held_back = [], 0

            def settle(keys: list, rows: int) -> None:
                seen = np.zeros(rows * size, bool)
                seen[np.concatenate(keys)] = True
                total[:size] += seen.reshape(rows, size).sum(axis=0)

            for n, raw in zip(b["n"].tolist(), b["ids"], strict=True):
                spans = np.array(windows(n, length, stride)).reshape(-1, 2)
                passages += len(spans)
                if not raw:
                    continue
                ids = np.frombuffer(raw, number).astype(np.int64)
                at = np.flatnonzero((ids >= 0) & (ids < size))
                mine = ids[at]
                # a word lies in the windows from the first that ends after it to the last that starts before it
                first, last = np.searchsorted(spans[:, 1], at, "right"), np.searchsorted(spans[:, 0], at, "right")
                for k in range(int((last - first).max(initial=0))):
                    here = first + k < last
                    keys.append((held_back + first[here] + k) * size + mine[here])
                held_back += len(spans)
                if held_back >= 2048 and keys:
                    settle(keys, held_back)
                    keys, held_back = [], 0
            if keys:
                settle(keys, held_back)
        total[size] = passages
        yield pd.DataFrame({"term": np.flatnonzero(total), "n": total[total > 0]})

    df = np.zeros(size + 1)
    for r in coded.select("h", "n", "ids").dropDuplicates(["h"]).mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # as many rows as words
        df[r["term"]] = r["n"]
    total = max(df[size], 1.0)
    own = [[vocabulary[w] for w in ws] for _, ws, _ in held]
    idf = np.log((1 + total) / (1 + df[:size])) + 0.1
    idf[(df[:size] > max_df * total) & (df[:size] > 50)] = 0.0
    weighty = np.r_[idf > 0, np.zeros(len(vocabulary) - size + 1, bool)]  # the last place is that of -1

    seeds: dict[tuple[int, ...], set[int]] = {}
    grams = []
    for k_item, ws in enumerate(own):
        g: dict[tuple[int, ...], list[int]] = {}
        n = seed_length(len(ws), tolerance)
        for k in range(len(ws) - n + 1):
            g.setdefault(tuple(ws[k : k + n]), []).append(k)
            seeds.setdefault(tuple(ws[k : k + n]), set()).add(k_item)
        grams.append(g)
    lengths = sorted({len(x) for x in seeds})
    # seeds as sorted hashes of their terms: what hits one is looked up exactly later
    hashed = {n: np.unique(_hashes(np.array([x for x in seeds if len(x) == n], np.int64).ravel(), n)[::n]) for n in lengths}
    # items by one word of their answers
    answers = [frozenset(vocabulary[w] for w in answer) for _, _, answer in held]
    by_answer: dict[int, list[int]] = {}
    for k_item, (_, _, answer) in enumerate(held):
        if answer:
            by_answer.setdefault(vocabulary[max(answer, key=len)], []).append(k_item)
    keys_of_answers = np.zeros(len(vocabulary) + 1, bool)
    keys_of_answers[list(by_answer)] = True

    def answered(ids: np.ndarray) -> set[int]:
        marks = np.unique(ids[keys_of_answers[ids]]).tolist()
        if not marks:
            return set()
        present = {*ids.tolist()}
        return {k for w in marks for k in by_answer[w] if present.issuperset(answers[k])}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, raw in zip(b["d"], b["ids"], strict=True):
                small = np.frombuffer(raw, number)
                ids = small.astype(np.int64)
                good = weighty[ids]
                hits = [(n, np.r_[0, np.cumsum(x)].tolist()) for n in lengths if (x := _hits(ids, n, hashed[n])).any()]
                able = bool(keys_of_answers[ids].any())
                if not (hits or able or good.any()):
                    continue
                for lo, hi in windows(len(ids), length, stride):
                    mine = small[lo:hi][good[lo:hi]]
                    if not (len(mine) or hits or able):
                        continue
                    a, b = max(0, lo - margin), min(len(ids), hi + margin)
                    seeded = any(b - a >= n and c[b - n + 1] > c[a] for n, c in hits)
                    if seeded or len(mine) or (able and answered(ids[a:b])):
                        rows.append((d, small[a:b].tobytes(), np.sort(mine).astype(np.int32).tobytes(), seeded))
            yield pd.DataFrame(rows, columns=["d", "p", "ids", "seeded"])

    passages = coded.where(F.length("ids") > 0).select("d", "ids").mapInPandas(cut, "d long, p binary, ids binary, seeded boolean").checkpoint()

    spans = [[ws[lo:hi] for lo, hi in windows(len(ws), 24, 8)] for ws in own]
    window_ids = [[t for t in w if weighty[t]] for per in spans for w in per]
    owner = np.array([k for k, per in enumerate(spans) for _ in per])
    keep = [k for k, w in enumerate(window_ids) if w]
    faint = {int(owner[k]) for k, w in enumerate(window_ids) if not w}  # items with windows that have no direction
    window_ids, owner = [window_ids[k] for k in keep], owner[keep]
    rank = min(rank, size)
    irow, iterm, iw = _rows(window_ids, idf)

    def gram(y: np.ndarray) -> np.ndarray:
        """A'A y over all passages and, in equal measure, the item windows."""
        small = y.astype(np.float32)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc, n = np.zeros(small.shape), 0
            for b in batches:
                for lo in range(0, len(b), 2048):
                    ids = [np.frombuffer(x, np.int32) for x in b["ids"].iloc[lo : lo + 2048]]
                    row, term, w = _rows(ids, idf)
                    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    z = np.add.reduceat(small[term] * w[:, None].astype(np.float32), starts, axis=0)
                    order = np.argsort(term, kind="stable")
                    t, back = term[order], (z[np.searchsorted(row[starts], row)] * w[:, None])[order]
                    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                    acc[t[first]] += np.add.reduceat(back, first, axis=0)
                    n += len(ids)
            yield _pieces(acc)

        # several partitions a task, so that there are as many matrices as cores, however large the corpus
        wide = passages.where(F.length("ids") > 0).select("ids").coalesce(2 * slots(spark))
        total_part = _sum_matrices(wide.mapInPandas(part, "k int, m binary"), small.shape)
        mine = np.zeros(small.shape)
        starts = np.flatnonzero(np.r_[True, irow[1:] != irow[:-1]])
        z = np.add.reduceat(small[iterm] * iw[:, None], starts, axis=0)
        np.add.at(mine, iterm, z[np.searchsorted(irow[starts], irow)] * iw[:, None])
        scale = np.linalg.norm(total_part) / max(np.linalg.norm(mine), 1e-9) if total_part.any() else 1.0
        return total_part + max(1.0, scale) * mine

    rng = np.random.default_rng(seed)
    if window_ids:
        q, _ = np.linalg.qr(gram(rng.standard_normal((size, rank))))
        h = q.T @ gram(q)
        _, u = np.linalg.eigh((h + h.T) / 2)
        basis = (q @ u[:, ::-1][:, :rank]).astype(np.float32)
        targets = _unit(_latent(window_ids, idf, basis))
    else:
        basis, targets = np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32)
    # the threshold: what 12 words of an item, one of them lost, still reach against that item's windows
    trial, of = [], []
    for k, ws in enumerate(own):
        for lo in range(0, max(1, len(ws) - least + 1), 3):
            piece = [t for t in ws[lo : lo + least]]
            if len(piece) > 1:
                del piece[int(rng.integers(len(piece)))]
            piece = [t for t in piece if weighty[t]]
            if piece:
                trial.append(piece)
                of.append(k)
    if trial and len(targets):
        s = _unit(_latent(trial, idf, basis))
        best = np.zeros(len(trial))
        for k in range(0, len(trial), 4096):
            c = s[k : k + 4096] @ targets.T
            c[owner[None, :] != np.array(of[k : k + 4096])[:, None]] = -1
            best[k : k + 4096] = c.max(axis=1)
        threshold = float(max(0.05, 0.6 * np.quantile(best, 0.005)))
    else:
        threshold = 0.05

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for lo in range(0, len(b), 1024):
                part = b.iloc[lo : lo + 1024]
                # passages with the same weighted words have the same direction
                codes, bags = pd.factorize(part["ids"])
                near = _unit(_latent([np.frombuffer(x, np.int32) for x in bags], idf, basis)) @ targets.T >= threshold
                bag, win = np.nonzero(near)
                pairs = np.unique(bag * len(held) + owner[win])
                of_bag = np.split(pairs % len(held), np.searchsorted(pairs // len(held), np.arange(1, len(bags)))) if len(bags) else []
                texts, numbers, marks = part["p"].tolist(), part["d"].tolist(), part["seeded"].tolist()
                for k, c in enumerate(codes.tolist()):
                    if not (len(of_bag[c]) or marks[k] or faint or not bags[c]):
                        continue
                    ids = np.frombuffer(texts[k], number).astype(np.int64)
                    able = answered(ids)
                    if not marks[k] and not able:
                        continue
                    passage = ids.tolist()
                    seeded: set[int] = set()
                    for n in lengths if marks[k] else ():
                        for at in np.flatnonzero(_hits(ids, n, hashed[n])).tolist():
                            seeded |= seeds.get(tuple(passage[at : at + n]), set())
                    # without a direction the answers alone say what to compare
                    able &= {*of_bag[c].tolist(), *faint, *seeded} if bags[c] else able
                    for item in sorted(seeded | able):
                        name, ws = held[item][0], own[item]
                        if (name, numbers[k], "passage") in rows:
                            continue
                        if item in seeded and aligned(ws, grams[item], passage, least, tolerance):
                            rows.add((name, numbers[k], "passage"))
                        elif item in able and common_share(ws, passage) >= 0.6:
                            rows.add((name, numbers[k], "paraphrase"))
            yield pd.DataFrame(sorted(rows), columns=["item_id", "doc_id", "kind"])

    return passages.mapInPandas(search, "item_id long, doc_id long, kind string")
