"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 per language. Counts of 4-grams are taken over all
training texts in parallel; the lower orders follow from the distinct 4-grams
(continuation counts), so one count table is enough. Probabilities are kept in
back-off form in sorted arrays of hashed n-grams shared by all languages, with
a column each: one lookup of the highest known order scores a character under
every language.

A text goes to the language of the lowest cross-entropy per character. Whether
it is rejected depends on its distance: it is cut into parts of PART characters,
each counts under the language that suits it best (so a text that mixes known
languages is close), and their mean must not exceed the limit of the text's
language for its length.

Limits are calibrated by leaving each language out: all training texts are cut
into windows of LENGTHS characters, and the distance of each is taken with all
languages and without its own, which is what it would get if that were unknown. The limit of a language and length is where REFUSED times the share of
own windows beyond it plus the share of foreign windows within it is least (the
middle, if a range is). Between lengths it is interpolated. Texts shorter than
the first length are not rejected for their distance.

All counts are kept. A model of more than SHARD_GRAMS counts is cut into shards
by the two middle symbols of a 4-gram: continuation counts, contexts and
back-off of orders 4 and 3 stay within a shard, discounts and the tables of
orders 2 and 1 (bounded by the alphabet) are taken over all of it. The driver
builds and broadcasts a shard at a time, a worker scores with one at a time.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, mix, slices, stored, text_arrays, texts

ORDER = 4
#: Counts of one shard of the model, about: bounds what is broadcast at once, not what is kept.
SHARD_GRAMS = 1_200_000
#: Characters of calibration windows, nats a bin and bins of their histograms, windows a limit needs at least.
LENGTHS, BIN, BINS, LEAST = (8, 32, 128, 512, 2048), 0.05, 320, 20
#: Characters of a part.
PART = 128
#: Weight of a refused own window against an accepted foreign one; nats beyond all but a thousandth of the own windows, with no other language.
REFUSED, ALONE = 10.0, 1.0
#: Sharpness of the score.
SHARP = 12.0
SPACE, OTHER = 32, 0xFFFF
UND = "und"


@functools.cache
def symbols() -> np.ndarray:
    """Code point -> symbol: letters are themselves (one symbol beyond the basic plane), the rest is space."""
    out = np.full(0x110000, SPACE, np.uint16)
    at = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    out[at] = np.where(at < OTHER, at, OTHER)
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams (16 bits a symbol) ending at each symbol of each text, and the n + 1 offsets.

    Lower case; a run of other characters is one space; a text starts after
    spaces. Texts without a letter have none.
    """
    low = [t.lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    off = np.concatenate([[0], np.cumsum(size)])
    s = symbols()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = s == SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    starts = off[:-1][size > 0]
    keep[starts] = ~space[starts]
    at = np.flatnonzero(keep)
    cut = np.searchsorted(at, off)
    alone = np.add.reduceat(np.append(~space, False).astype(np.int64), off[:-1]) if len(low) else np.zeros(0, np.int64)
    alone[size == 0] = 0
    doc = np.repeat(np.arange(len(low)), np.diff(cut))
    padded = np.full(len(at) + (ORDER - 1) * len(low), SPACE, np.uint64)
    place = np.arange(len(at)) + (ORDER - 1) * (doc + 1)
    padded[place] = s[at]
    key = np.zeros(len(at), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        key = (key << np.uint64(16)) | padded[place - k]
    has = np.repeat(alone > 0, np.diff(cut))
    if not has.all():
        key, cut = key[has], np.concatenate([[0], np.cumsum(np.where(alone > 0, np.diff(cut), 0))])
    return key, cut


# --- counting

def count_grams(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over the texts of train (text, lang)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            g, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.zeros(len(g), np.int64)
            np.add.at(n, inv, np.concatenate([p[1] for p in parts]))
            return g, n

        def rows(lang: str) -> pa.RecordBatch:
            g, n = merge(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for b in it:
            _, off = text_arrays(b.column(0))
            for i, j in slices(off, 1 << 20):
                of: dict[str, list[str]] = {}
                for t, lang in zip(b.column(0).slice(i, j - i).to_pylist(), b.column(1).slice(i, j - i).to_pylist()):
                    of.setdefault(lang, []).append(t or "")
                for lang, own in of.items():
                    held.setdefault(lang, []).append(np.unique(grams(own)[0], return_counts=True))
                    if sum(len(p[0]) for p in held[lang]) > 1 << 20:
                        held[lang] = [merge(held[lang])]
                        if len(held[lang][0][0]) > 1 << 19:  # bounded memory: hand over what there is
                            yield rows(lang)
        for lang in list(held):
            yield rows(lang)
        give_back()

    return train.select("text", "lang").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# --- the model

class Lookup:
    """Sorted hashes of 64-bit keys with a row of values each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix(keys)
        order = np.argsort(h)
        self.hash, self.values = h[order], np.ascontiguousarray(values[order], np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each key (0 where absent) and whether it is present."""
        if not len(self.hash):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        h = mix(keys)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return at, self.hash[at] == h


def _discount(n: np.ndarray) -> float:
    one, two = int((n == 1).sum()), int((n == 2).sum())
    return one / (one + 2 * two) if one and two else 0.75


class _Language:
    """Interpolated Kneser-Ney by order: (keys, probabilities) and (contexts, back-off weights), sorted."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, whole: dict[int, tuple[np.ndarray, np.ndarray]] | None = None, discounts: dict[int, float] | None = None):
        """For a shard: `whole` has the tables of orders 2 and 1, `discounts` those of all orders."""
        tables = {ORDER: (keys, counts), **(whole or {})}
        for o in range(ORDER - 1, 0, -1):
            if o in tables:
                continue
            low = tables[o + 1][0] & np.uint64((1 << 16 * o) - 1)
            tables[o] = np.unique(low, return_counts=True)
        self.p: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.bow: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.unseen = 1.0 / (len(tables[1][0]) + 1)
        for o in range(1, ORDER + 1):
            k, n = tables[o]
            d = discounts[o] if discounts else _discount(n)
            ctx = k >> np.uint64(16) if o > 1 else np.zeros(len(k), np.uint64)
            c, first = np.unique(ctx, return_index=True)
            total = np.add.reduceat(n, first).astype(float) if len(n) else np.zeros(0)
            kinds = np.diff(np.append(first, len(k)))
            lam = d * kinds / total
            i = np.searchsorted(c, ctx)
            lower = self.prob(o - 1, k & np.uint64((1 << 16 * (o - 1)) - 1))
            self.bow[o] = (c, lam)
            self.p[o] = (k, np.maximum(n - d, 0) / total[i] + lam[i] * lower)

    def prob(self, o: int, keys: np.ndarray) -> np.ndarray:
        if o == 0:
            return np.full(len(keys), self.unseen)
        k, p = self.p[o]
        if len(k):
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            hit = k[at] == keys
            out = p[at].copy()
        else:
            hit, out = np.zeros(len(keys), bool), np.zeros(len(keys))
        miss = ~hit
        if miss.any():
            m = keys[miss]
            out[miss] = self.weight(o, m >> np.uint64(16) if o > 1 else np.zeros(len(m), np.uint64)) * self.prob(o - 1, m & np.uint64((1 << 16 * (o - 1)) - 1))
        return out

    def weight(self, o: int, ctx: np.ndarray) -> np.ndarray:
        c, lam = self.bow[o]
        if not len(c):
            return np.ones(len(ctx))
        at = np.minimum(np.searchsorted(c, ctx), len(c) - 1)
        return np.where(c[at] == ctx, lam[at], 1.0)


class Model:
    """All languages together; scoring returns nats per character for each."""

    def __init__(self, counts: dict[str, tuple]):
        self.langs = sorted(counts)
        each = [_Language(*counts[x]) for x in self.langs]
        self.p, self.bow = {}, {}
        self.unseen = np.log([m.unseen for m in each]) if each else np.zeros(0)
        for o in range(1, ORDER + 1) if each else ():
            keys = np.unique(np.concatenate([m.p[o][0] for m in each]))
            self.p[o] = Lookup(keys, np.log(np.stack([m.prob(o, keys) for m in each], axis=1)))
            ctx = np.unique(np.concatenate([m.bow[o][0] for m in each]))
            self.bow[o] = Lookup(ctx, np.log(np.stack([m.weight(o, ctx) for m in each], axis=1)))

    def logs(self, keys: np.ndarray, o: int = ORDER) -> np.ndarray:
        if o == 0:
            return np.broadcast_to(self.unseen.astype(np.float32), (len(keys), len(self.langs)))
        at, hit = self.p[o].find(keys)
        out = self.p[o].values[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            m = keys[miss]
            low = self.logs(m & np.uint64((1 << 16 * (o - 1)) - 1), o - 1)
            at, hit = self.bow[o].find(m >> np.uint64(16) if o > 1 else np.zeros(len(m), np.uint64))
            out[miss] = low + np.where(hit[:, None], self.bow[o].values[at], 0)
        return out


def sums(logs: np.ndarray) -> np.ndarray:
    """Running sums of the nats of each character, one more row than logs."""
    out = np.zeros((len(logs) + 1, logs.shape[1]))
    np.cumsum(logs, axis=0, dtype=np.float64, out=out[1:])
    return np.negative(out, out=out)


def entropies(total: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Nats per character of each text under each language (0 where none)."""
    return (total[cut[1:]] - total[cut[:-1]]) / np.maximum(np.diff(cut), 1)[:, None]


def distances(total: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Mean nats per character of each text, every part under its best language; the last part takes the rest."""
    n = np.diff(cut)
    k = np.where(n > 0, np.maximum(n // PART, 1), 0)
    out = np.zeros(len(n))
    if not total.shape[1] or not k.sum():
        return out
    text, last = np.repeat(np.arange(len(n)), k), np.cumsum(k) - 1
    a = cut[text] + PART * (np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k))
    z = a + PART
    z[last[k > 0]] = cut[1:][k > 0]
    out[k > 0] = np.add.reduceat((total[z] - total[a]).min(1), (np.cumsum(k) - k)[k > 0]) / n[k > 0]
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 4-gram, by its two middle symbols."""
    b, c = (keys >> np.uint64(32)) & np.uint64(0xFFFF), (keys >> np.uint64(16)) & np.uint64(0xFFFF)
    return ((b * np.uint64(40503) + c * np.uint64(30011)) % np.uint64(65521) % np.uint64(shards)).astype(np.int64)


def _shard_column(gram: Column, shards: int) -> Column:
    b, c = (F.shiftrightunsigned(gram, k).bitwiseAND(F.lit(0xFFFF)) for k in (32, 16))
    return (b * 40503 + c * 30011) % 65521 % shards


def _tables(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and their counts of each language, on the driver."""
    rows: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for lang in sorted(r["lang"] for r in counts.select("lang").distinct().collect()):
        t = counts.where(F.col("lang") == lang).select("gram", "n").toArrow()
        g, n = t.column("gram").to_numpy().view(np.uint64), t.column("n").to_numpy()
        order = np.argsort(g)
        rows[lang] = (g[order], n[order])
    return rows


def train_models(train: DataFrame) -> Iterator[tuple[int, Model]]:
    """(number of shards, shard of the model) of the texts of train (text, lang not null), one after the other."""
    counts = stored(count_grams(train.where("lang is not null and text is not null")), "grams")
    shards = max(1, -(-counts.count() // SHARD_GRAMS))
    if shards == 1:
        yield 1, Model(_tables(counts))
        return
    orders = {ORDER: counts}
    for o in range(ORDER - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << 16 * o) - 1)).alias("gram")
        orders[o] = stored(orders[o + 1].select("lang", low).groupBy("lang", "gram").agg(F.count("*").alias("n")), "grams")
    discounts: dict[str, dict[int, float]] = {}
    for o, t in orders.items():
        for r in t.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect():  # a row a language
            discounts.setdefault(r["lang"], {})[o] = r["one"] / (r["one"] + 2 * r["two"]) if r["one"] and r["two"] else 0.75
    two, one = _tables(orders[2]), _tables(orders[1])
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for k in range(shards):
        own = _tables(counts.where(_shard_column(F.col("gram"), shards) == k))
        yield shards, Model({x: (*own.get(x, none), {2: two[x], 1: one[x]}, discounts[x]) for x in discounts})


def sharded_logs(keys: np.ndarray, shards: int, langs: int, shard) -> np.ndarray:
    """`Model.logs` with a model of several shards; shard(k) gives one."""
    if not langs:
        return np.zeros((len(keys), 0), np.float32)
    if shards == 1:
        return shard(0).logs(keys)
    which = shard_of(keys, shards)
    out = np.zeros((len(keys), langs), np.float32)
    for k in range(shards):
        mine = np.flatnonzero(which == k)
        if len(mine):
            out[mine] = shard(k).logs(keys[mine])
    return out


# --- calibration

def histograms(total: np.ndarray, cut: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Counts [length, side, language, bin] of the windows of texts whose language is own (-1: left out).

    Side 0: distance with all languages, counted for the own one. Side 1: without it, counted for the best other one.
    """
    langs = total.shape[1]
    out = np.zeros((len(LENGTHS), 2, langs, BINS), np.int64)
    n = np.diff(cut)
    for x, size in enumerate(LENGTHS):
        k = np.where(own >= 0, n // size, 0)
        if not k.sum():
            continue
        text = np.repeat(np.arange(len(n)), k)
        start = cut[text] + size * (np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k))
        each = min(size, PART)
        part = (start[:, None] + each * np.arange(size // each + 1)).ravel()
        h = np.diff(total[part].reshape(len(start), -1, langs), axis=1) / each
        mine = own[text]
        for side in range(2 if langs > 1 else 1):
            at = np.minimum(h.min(2).mean(1) / BIN, BINS - 1).astype(np.int64)
            best = mine if side == 0 else h.mean(1).argmin(1)
            out[x, side] = np.bincount(best * BINS + at, minlength=langs * BINS).reshape(langs, BINS)
            h[np.arange(len(h)), :, mine] = np.inf
    return out


def limit_of(own: np.ndarray, other: np.ndarray) -> float | None:
    """Where to reject, from the histograms of own and foreign windows; None if there are too few own ones."""
    if own.sum() < LEAST:
        return None
    beyond = 1 - np.cumsum(own) / own.sum()
    if other.sum() < LEAST:
        return float((np.flatnonzero(beyond <= 1e-3)[0] + 1) * BIN + ALONE)
    cost = REFUSED * beyond + np.cumsum(other) / other.sum()
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    return float((best[0] + best[-1] + 2) / 2 * BIN)


def _limits(counted: DataFrame, langs: list[str]) -> list[tuple[str, list[float]]]:
    """(language, limit of each of LENGTHS) of the languages that have one; counted: lang, length, side, bin, k."""
    held = np.zeros((len(LENGTHS), 2, len(langs), BINS), np.int64)
    for r in counted.groupBy("lang", "length", "side", "bin").agg(F.sum("k").alias("k")).toLocalIterator():  # bounded by the bins
        held[r["length"], r["side"], langs.index(r["lang"]), r["bin"]] = r["k"]
    out = []
    for x, lang in enumerate(langs):
        each: list[float] = []
        for k in range(len(LENGTHS)):
            t = limit_of(held[k, 0, x], held[k, 1, x])
            if t is None and not each:
                break
            each.append(each[-1] if t is None else t)
        if each:
            out.append((lang, each))
    return out


OUT = "md5 binary, doc_id bigint, train boolean, n bigint, lang_pred string, score double, h double, lang string, length int, side int, bin int, k bigint"


def identify(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """doc_id, train, n, lang_pred, score, rejected and md5 (of the text) of each row of docs (doc_id, text, lang; other columns ignored).

    `train` says which rows to learn from (default: all); of these, the ones
    with a lang. lang and doc_id are no inputs of a prediction. Texts that are
    null or have no letter get `und`, score 0, and are rejected; so is every
    text if there is nothing to learn from. score is the share of the best
    language in a softmax of cross-entropies. rejected also holds for texts
    whose distance is beyond the best language's limit; lang_pred stays the
    best guess for them.
    """
    spark = docs.sparkSession
    src = texts(docs, F.col("lang").cast("string").alias("lang"), F.coalesce(train if train is not None else F.lit(True), F.lit(False)).alias("train"))
    shared, langs = [], []
    for _, model in train_models(src.where("train")):
        shared.append(spark.sparkContext.broadcast(model))
        langs = model.langs
        shared[-1].__dict__.pop("_value", None)  # the driver holds a shard at a time
        del model
    names = pa.schema([("md5", pa.binary()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("h", pa.float64()),
                       ("lang", pa.string()), ("length", pa.int32()), ("side", pa.int32()), ("bin", pa.int32()), ("k", pa.int64())])

    def rows(count: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(count, f.type) for f in names], schema=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(k: int) -> Model:
            m = shared[k].value
            if len(shared) > 1:  # so does a worker
                shared[k].__dict__.pop("_value", None)
            return m

        held = np.zeros((len(LENGTHS), 2, len(langs), BINS), np.int64)
        index = {x: k for k, x in enumerate(langs)}
        room = (1 << (18 if len(shared) == 1 else 22)) * 4 // max(4, len(langs))
        for b in it:
            _, off = text_arrays(b.column(1))
            for i, j in slices(off, room):
                body = [t or "" for t in b.column(1).slice(i, j - i).to_pylist()]
                learn = b.column(3).slice(i, j - i).to_pylist()
                keys, cut = grams(body)
                n = np.diff(cut)
                total = sums(sharded_logs(keys, len(shared), len(langs), shard))
                h = entropies(total, cut)
                if langs:
                    best = h.argmin(1)
                    low = h[np.arange(len(h)), best]
                    score = 1 / np.exp(-SHARP * (h - low[:, None])).sum(1)
                    own = np.array([index.get(x, -1) if t else -1 for x, t in zip(b.column(2).slice(i, j - i).to_pylist(), learn)], np.int64)
                    held += histograms(total, cut, own)
                    low = distances(total, cut)
                else:
                    best, low, score, n = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n)), n * 0
                yield rows(j - i, md5=[hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in body], doc_id=b.column(0).slice(i, j - i).to_pylist(), train=learn, n=n,
                           lang_pred=[langs[k] if c else UND for k, c in zip(best, n)], score=np.where(n > 0, score, 0.0), h=low)
        give_back()
        length, side, lang, at = np.nonzero(held)
        if len(at):
            yield rows(len(at), lang=[langs[x] for x in lang], length=length, side=side, bin=at, k=held[length, side, lang, at])

    out = stored(src.select("doc_id", "text", "lang", "train").mapInArrow(run, OUT), "languages")
    limits = _limits(out.where("length is not null"), langs)
    told = out.where("length is null").drop("lang", "length", "side", "bin", "k")
    table = F.broadcast(spark.createDataFrame(limits, "lang_pred string, limits array<double>"))  # a row a language
    place = F.log(F.col("n") / LENGTHS[0]) / F.log(F.lit(LENGTHS[1] / LENGTHS[0]))
    place = F.least(F.greatest(place, F.lit(0.0)), F.lit(len(LENGTHS) - 1.0))
    low, high = (F.element_at("limits", f.cast("int") + 1) for f in (F.floor(place), F.ceil(place)))
    limit = low + (high - low) * (place - F.floor(place))
    far = F.coalesce((F.col("n") >= LENGTHS[0]) & (F.col("h") > limit), F.lit(False))
    return told.join(table, "lang_pred", "left").select("doc_id", "train", "n", "lang_pred", "score", ((F.col("n") == 0) | far).alias("rejected"), "md5")


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is not rejected, learned from all rows with a lang; columns as they are.

    Rows are told apart by their text, so null and repeated ids do not matter;
    the join moves texts only if the rejected ones are too many to broadcast
    (Spark checks the size).
    """
    gone = stored(identify(docs).where("rejected").select("md5").distinct(), "rejected")
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return docs.join(gone, key == gone["md5"], "left_anti")
