"""Sentence alignment in bilingual collections (problem 2).

Sentences that share names or numbers within a session seed a translation table, estimated by distributed
expectation-maximisation (each word of one language explains words of the other). The table brings both languages to
common lexemes; sentences of a session that share several rare ones are candidates. Competitive linking accepts the
best pair anywhere first; a sentence left over may join a linked one whose remaining words it explains (merges), and
what nobody explains is an omission. A session up to LOCAL sentences is linked within one task, a larger one by keys
and rounds over all executors, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.stages import drop_stage, stage
from folioscope.operators.windows import numbered_evenly
from folioscope.llm.arrow import collected, map_batches, mix
from folioscope.llm.sentences import Model, _flat, _tidy, estimate, gap_table, posteriors

#: Word codes and slots of the translation table (both hashed, so that their size is fixed); rounds of estimation.
WORDS, TABLE, ROUNDS = 1 << 20, 1 << 22, 5
#: Least probability of a translation, and how often its word must have been seen.
LIKELY, SEEN = 0.12, 3
#: Least share of a translation's occurrences that a word must explain: what merely stands beside it explains little.
EXPLAINED = 0.1
#: Sentences of one language up to which all pairs that share a seed's names and numbers are taken; of more, each is
#: paired with those that stand at its place among the other language's.
SEED_SIDES = 2
#: Least expected count of one pair of words in one seed, and the unit that such counts are whole multiples of: sums
#: do not depend on the order or the number of tasks.
LEAST_COUNT, UNIT = 1e-3, 2.0**-20
#: Sentences of a session that one task links by itself.
LOCAL = 2048
#: Least share of the lighter sentence's weight that a pair has in common, and least likeness of all.
CONTAINED, ALIKE = 0.6, 0.25
#: Likeness from which a pair stands alone; below, another pair of the same two passages must support it.
ALONE = 0.75
_FR = re.compile(r"[^\W\d_]{3,}|\d+")
_ZH = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]{4,}|\d+")


def _code(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


@lru_cache(1 << 17)
def _word(w: str) -> int:
    """Code of a word without case and accents, or of a pair of characters."""
    if not w.isascii() and w[0] < "\u2e80":
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    return _code(w.lower()) % WORDS


def words_of(sentence: str, zh: bool) -> tuple[list[int], list[int]]:
    """Codes of names and numbers (the same in both languages, from 2**20 on) and of words (of characters by twos)."""
    text = _tidy(sentence)
    anchors, words = [], []
    for w in (_ZH if zh else _FR).findall(text):
        if w[0].isdigit():
            anchors.append(WORDS + _code(w.lstrip("0")) % WORDS)
        elif "㐀" <= w[0] <= "鿿":
            words += [_word(w[i : i + 2]) for i in range(max(1, len(w) - 1))]
        else:
            if zh or (w[0].isupper() and len(w) > 5):
                anchors.append(WORDS + _word(w))
            if not zh:
                words.append(_word(w))
    return list(dict.fromkeys(anchors)), list(dict.fromkeys(words))


def sentence_table(gaps: DataFrame, model: Model, second: str = "zh") -> DataFrame:
    """Stage table id, end_char, session, zh (of the second language), anchors, words of the sentences of texts.

    gaps has a text's gaps with id, session_id, language, text; each (id, session_id) is expected once.
    """
    shipped = gaps.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(b: pa.RecordBatch):
            size, (end, *rest), _, _ = _flat(b)
            keep = posteriors(shipped.value, size, end, *rest)[0] >= 0.5
            owner, ends, anchors, words, at = [], [], [], [], 0
            na, nw = [0], [0]
            for k, (text, lang, n) in enumerate(zip(b.column("text").to_pylist(), b.column("language").to_pylist(), size.tolist())):
                last, han = 0, lang == "zh"
                for e in end[at : at + n][keep[at : at + n]].tolist():
                    a, w = words_of(text[last:e], han)
                    owner.append(k)
                    ends.append(e)
                    anchors += a
                    words += w
                    na.append(len(anchors))
                    nw.append(len(words))
                    last = e
                at += n
            if not ends:
                return None
            rows = pa.array(owner)
            zh = pc.equal(b.column("language"), second).take(rows)
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int32())) for o, v in ((na, anchors), (nw, words))]
            return pa.RecordBatch.from_arrays([b.column("id").take(rows), pa.array(ends, pa.int32()), b.column("session_id").take(rows), zh, *lists], ["id", "end_char", "session", "zh", "anchors", "words"])

        return step

    return stage(map_batches(gaps, "id string, end_char int, session string, zh boolean, anchors array<int>, words array<int>", make), "sentences")


def seed_pairs(sentences: DataFrame) -> DataFrame:
    """Stage table f, z (words of either side) of sentences that share two names or numbers within a session, or their only one.

    However many sentences share a key, all take part: up to SEED_SIDES a side in all pairs, more of them along the
    diagonal of their order, since translations keep to it roughly. Two sentences are one seed at most.
    """
    pairs = F.flatten(F.transform("anchors", lambda a: F.transform(F.filter("anchors", lambda b: b > a), lambda b: F.xxhash64("session", a, b))))
    wanted = sentences.where("size(anchors) > 0 and size(words) > 0")
    keys = wanted.select("id", "end_char", "zh", "words", F.explode(F.when(F.size("anchors") > 1, pairs).otherwise(F.transform("anchors", lambda a: F.xxhash64("session", a)))).alias("k"))
    sides = keys.groupBy("k").agg(F.count_if("zh").alias("nz"), F.count_if(~F.col("zh")).alias("nf")).where("nz > 0 and nf > 0")
    keyed = stage(keys.join(sides, "k"), "seed-keys")
    few = keyed.where((F.col("nf") <= SEED_SIDES) & (F.col("nz") <= SEED_SIDES)).withColumn("place", F.lit(0).cast("long"))
    many = numbered_evenly(keyed.where((F.col("nf") > SEED_SIDES) | (F.col("nz") > SEED_SIDES)), ["k", "zh"], ["id", "end_char"], "seq")
    # Of the longer side every sentence takes the one at its place of the shorter side: the place is that side's number.
    other, own = F.when(F.col("zh"), F.col("nf")).otherwise(F.col("nz")), F.when(F.col("zh"), F.col("nz")).otherwise(F.col("nf"))
    place = F.when(own > other, F.floor((F.col("seq") - 1) * other / own) + 1).otherwise(F.col("seq"))
    every = few.unionByName(many.withColumn("place", place).drop("seq"))
    side = lambda zh, name, words: every.where("zh" if zh else "not zh").select("k", "place", F.struct("id", "end_char").alias(name), F.col("words").alias(words))
    met = side(False, "fu", "f").join(side(True, "zu", "z"), ["k", "place"])
    seeds = stage(met.dropDuplicates(["fu", "zu"]).select("f", "z"), "seeds")
    drop_stage(keyed)
    return seeds


def _products(b: pa.RecordBatch, rows: int = 2000):
    """Of rows of seeds: words f and z of all their pairs of words, and which occurrence of z each belongs to."""
    for at in range(0, b.num_rows, rows):
        part = b.slice(at, rows)
        nf, nz = (pc.list_value_length(part.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("f", "z"))
        f, z = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("f", "z"))
        row = np.repeat(np.arange(len(nf)), nf * nz)
        k = np.arange(len(row)) - np.repeat(np.cumsum(nf * nz) - nf * nz, nf * nz)
        own = (np.cumsum(nz) - nz)[row] + k % nz[row]
        yield f[(np.cumsum(nf) - nf)[row] + k // nz[row]], z[own], own


def _shares(f: np.ndarray, z: np.ndarray, own: np.ndarray, t: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each pair of words, and how much of z's occurrence f explains, in whole UNITs; nothing under LEAST_COUNT."""
    slot = ((f.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + z.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - TABLE.bit_length() + 1)).astype(np.int64)
    p = t[slot] / (mass[f] + 0.1)
    p = p / (np.bincount(own, p)[own] + 1e-9)
    return slot, np.where(p < LEAST_COUNT, 0.0, np.rint(p / UNIT) * UNIT)


def translation_table(seeds: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The likeliest translation of each word's code, -1 of others, by expectation-maximisation over the seed pairs.

    A round's table is a fixed number of hashed slots, the result one of the hashed words.
    """
    model = (np.ones(TABLE, np.float32), np.ones(WORDS, np.float32))
    context = seeds.sparkSession.sparkContext
    for _ in range(rounds):
        shipped = context.broadcast(model)

        def expect(batches, shipped=shipped):
            total, mass = np.zeros(TABLE), np.zeros(WORDS)
            for b in batches:
                for f, z, own in _products(b):
                    slot, p = _shares(f, z, own, *shipped.value)
                    np.add.at(total, slot, p)
                    np.add.at(mass, f, p)
            for kind, x in ((0, total), (1, mass)):
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], ["kind", "slot", "n"])

        got = collected(seeds.mapInArrow(expect, "kind int, slot int, n double").groupBy("kind", "slot").agg(F.sum("n").alias("n")))
        shipped.destroy()
        model = (np.zeros(TABLE, np.float32), np.zeros(WORDS, np.float32))
        for kind, x in enumerate(model):
            x[got["slot"][got["kind"] == kind]] = got["n"][got["kind"] == kind]
    norm = context.broadcast(model)

    def entries(batches):
        for b in batches:
            for f, z, own in _products(b):
                _, p = _shares(f, z, own, *norm.value)
                keep = p > 0.1
                both, at = np.unique(f[keep] * WORDS + z[keep], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array((both // WORDS).astype(np.int32)), pa.array((both % WORDS).astype(np.int32)), pa.array(np.bincount(at, p[keep], len(both)))], ["f", "z", "n"])

    n = seeds.mapInArrow(entries, "f int, z int, n double").groupBy("f", "z").agg(F.sum("n").alias("n"))
    often = seeds.select(F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("m")).where(f"m >= {SEEN}")
    held = seeds.select(F.explode("z").alias("z")).groupBy("z").agg(F.count("*").alias("nz"))
    n = n.join(held, "z").where(F.col("n") >= EXPLAINED * F.col("nz"))
    best = n.groupBy("f").agg(F.max(F.struct("n", "z")).alias("b")).join(often, "f").where(F.col("b.n") >= LIKELY * F.col("m")).select("f", F.col("b.z").alias("z"))
    to, got = np.full(WORDS, -1, np.int32), collected(best)
    to[got["f"]] = got["z"]
    norm.destroy()
    return to


def lexemes(sentences: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """Stage table u, session, id, end_char, zh, lex (common codes of words in their order, names and numbers), empty ones left out.

    u is a hash of session, id and end: it stands for a sentence within its session and breaks ties alike in every run.
    """
    shipped = sentences.sparkSession.sparkContext.broadcast(lexicon)
    carried = ["u", "session", "id", "end_char", "zh"]

    def make():
        to, known = shipped.value.astype(np.int64), np.zeros(WORDS, bool)
        known[to[to >= 0]] = True

        def step(b: pa.RecordBatch):
            zh = b.column("zh").to_numpy(zero_copy_only=False).astype(bool)
            rows, codes = [], []
            for c in ("words", "anchors"):
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False))
                code = b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if c == "words":
                    code = np.where(zh[row], np.where(known[code], code, -1), to[code])
                rows.append(row[code >= 0])
                codes.append(code[code >= 0])
            row, code = np.concatenate(rows), np.concatenate(codes)
            order = np.argsort(row, kind="stable")  # words in their order, then names and numbers
            row, code = row[order], code[order]
            first = np.sort(np.unique(row * (2 * WORDS) + code, return_index=True)[1])
            row, code = row[first], code[first]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
            lex = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code, pa.int32()))
            return pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), lex], [*carried, "lex"])

        return step

    rows = sentences.withColumn("u", F.xxhash64("session", "id", "end_char")).select(*carried, "anchors", "words")
    return stage(map_batches(rows, "u long, session string, id string, end_char int, zh boolean, lex array<int>", make).where("size(lex) > 0"), "lexemes")


def weights_of(lex: DataFrame) -> np.ndarray:
    """Weight by code of each lexeme that both languages use, log of its rarity; 0 of others. 2 * WORDS numbers."""
    n = lex.count()
    both = lex.select("zh", F.explode("lex").alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.count_if("zh").alias("nz")).where("nz > 0 and nz < n").select("x", "n")
    out, got = np.zeros(2 * WORDS, np.float32), collected(both)
    out[got["x"]] = np.rint((np.log(n / got["n"]) + 0.1) * 1024) / 1024  # sums of them are exact
    return out


@lru_cache(1 << 16)
def _session(session: str) -> int:
    return _code(session)


def rare_keys(row: np.ndarray, code: np.ndarray, w: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of lexemes and of pairs of them, such that all rows with ALIKE of either's weight in common share a key.

    row is ascending. A single lexeme in common must weigh that much itself. Of several, the two rarest are preceded in
    either row, rarest first, by at most the weight not in common and each other: later lexemes need no pairs.
    """
    order = np.lexsort((code, -w[code], row))
    row, code = row[order], code[order]
    weight = w[code].astype(np.float64)
    total = np.bincount(row, weight, minlength=len(base))[row] * (1 + 1e-6)  # sums are rounded
    start = np.flatnonzero(np.diff(row, prepend=-1))
    begin = np.repeat(start, np.diff(np.append(start, len(row))))
    before = np.cumsum(weight) - weight
    before -= before[begin]
    alone = weight >= ALIKE * total * (1 - 2e-6)
    owners, keys = [row[alone]], [_chain(base[row[alone]], code[alone, None])]
    ahead = (np.arange(len(row)) == begin) | (before - weight[begin] <= (1 - ALIKE) * total)
    row, code = row[ahead], code[ahead]
    for apart in range(1, int(np.bincount(row).max(initial=0))):
        at = np.flatnonzero(row[apart:] == row[:-apart])
        owners.append(row[at])
        keys.append(_chain(base[row[at]], np.stack([code[at], code[at + apart]], 1)))
    return np.concatenate(owners), np.concatenate(keys)


def _chain(base: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = base.copy()
    for k in range(codes.shape[1]):
        h = mix((h ^ codes[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return h


def _tie(fu: np.ndarray, zu: np.ndarray) -> np.ndarray:
    """A hash of a pair: among equal scores it decides, so that many equal pairs are linked in few rounds."""
    return mix(fu.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ zu.view(np.uint64)).view(np.int64)


def candidates(lex: DataFrame, weights: np.ndarray) -> DataFrame:
    """Stage table session, fu, zu, lf, lz, common, wf, wz, tie of sentences that share a rare key: lexemes and weights of either side, and the weight in common."""
    shipped = lex.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shipped.value

        def step(b: pa.RecordBatch):
            n = b.num_rows
            base = np.fromiter((_session(x) for x in b.column("session").to_pylist()), np.uint64, n)
            row = np.repeat(np.arange(n), pc.list_value_length(b.column("lex")).to_numpy(zero_copy_only=False))
            code = b.column("lex").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row, code = row[w[code] > 0], code[w[code] > 0]
            owner, keys = rare_keys(row, code, w, base)
            return pa.RecordBatch.from_arrays([b.column("u").take(pa.array(owner)), pa.array(keys.view(np.int64))], ["u", "k"])

        return step

    rows = lex.select("u", "session", "lex", "zh")
    f = map_batches(rows.where("not zh"), "u long, k long", make).toDF("fu", "k")
    z = map_batches(rows.where("zh"), "u long, k long", make).toDF("zu", "k")
    met = f.join(z, "k").select("fu", "zu").distinct()
    texts = lex.select("u", "session", "lex")
    both = met.join(texts.toDF("fu", "session", "lf"), "fu").join(texts.toDF("zu", "sz", "lz"), "zu").where("session = sz").select("session", "fu", "zu", "lf", "lz")

    def measure():
        def step(b: pa.RecordBatch):
            w = shipped.value
            common, wf, wz = (np.zeros(b.num_rows) for _ in range(3))
            for k, (f, z) in enumerate(zip(b.column("lf").to_pylist(), b.column("lz").to_pylist())):
                wf[k], wz[k] = w[f].sum(dtype=np.float64), w[z].sum(dtype=np.float64)
                common[k] = w[list(set(f).intersection(z))].sum(dtype=np.float64)
            keep = pa.array((common > 0) & (common >= CONTAINED * np.minimum(wf, wz)) & (common >= ALIKE * np.maximum(wf, wz)))
            tie = _tie(*(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fu", "zu")))
            out = [*b.columns, pa.array(common), pa.array(wf), pa.array(wz), pa.array(tie)]
            return pa.RecordBatch.from_arrays([c.filter(keep) for c in out], [*b.schema.names, "common", "wf", "wz", "tie"])

        return step

    return stage(map_batches(both, "session string, fu long, zu long, lf array<int>, lz array<int>, common double, wf double, wz double, tie long", measure), "candidates")


def link(pairs: DataFrame) -> DataFrame:
    """Stage table fu, zu of the greedy matching: in each round the pairs that are best for both their sentences.

    Taking the locally best pairs until none is left gives what taking the best pair anywhere again and again would.
    Equal scores go by the pair's hash, so that the rounds grow with the logarithm of the equal pairs.
    """
    score = (2 * F.col("common") / (F.col("wf") + F.col("wz"))).alias("score")
    left, taken = pairs.select("fu", "zu", score, "tie"), None
    while True:  # each round takes at least the best pair of all
        order = (F.desc("score"), F.asc("tie"), F.asc("fu"), F.asc("zu"))
        ranked = left.withColumns({"rf": F.row_number().over(Window.partitionBy("fu").orderBy(*order)), "rz": F.row_number().over(Window.partitionBy("zu").orderBy(*order))})
        best = stage(ranked.where("rf = 1 and rz = 1").select("fu", "zu"), "linked")
        if best.isEmpty():
            break
        taken = best if taken is None else taken.unionByName(best)
        before, left = left, stage(left.join(best.select("fu"), "fu", "left_anti").join(best.select("zu"), "zu", "left_anti"), "open")
        drop_stage(before)
    return taken if taken is not None else left.select("fu", "zu")


def merge(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """fu, zu of sentences left over that explain what the partner of a linked sentence does not."""
    own = pairs.join(linked, ["fu", "zu"], "left_semi").select("fu", "zu", "lf", "lz")
    rest_z = own.select("zu", F.array_except("lz", "lf").alias("rest"))
    rest_f = own.select("fu", F.array_except("lf", "lz").alias("rest"))
    share = F.size(F.array_intersect("rest", "mine")) / F.size("mine")
    extra_f = pairs.join(linked.select("fu"), "fu", "left_anti").join(rest_z, "zu").withColumn("mine", F.array_intersect("lf", "lz"))
    extra_z = pairs.join(linked.select("zu"), "zu", "left_anti").join(rest_f, "fu").withColumn("mine", F.array_intersect("lz", "lf"))
    more = [x.where((share >= 0.5) & (F.size("mine") >= 2)).withColumn("r", F.row_number().over(Window.partitionBy(side).orderBy(F.desc("common"), "tie", "fu", "zu"))).where("r = 1").select("fu", "zu") for x, side in ((extra_f, "fu"), (extra_z, "zu"))]
    return more[0].unionByName(more[1])


def linked_by_rounds(lex: DataFrame, weights: np.ndarray) -> DataFrame:
    """f_id, f_end, z_id, z_end, score of linked and merged sentences, by keys and rounds: sessions of any size."""
    pairs = candidates(lex, weights)
    linked = link(pairs)
    found = linked.unionByName(merge(pairs, linked)).distinct().join(pairs.select("session", "fu", "zu", (2 * F.col("common") / (F.col("wf") + F.col("wz"))).alias("score")), ["fu", "zu"])
    names = lex.select("session", "u", "id", "end_char")
    named = found.join(names.toDF("session", "fu", "f_id", "f_end"), ["session", "fu"]).join(names.toDF("session", "zu", "z_id", "z_end"), ["session", "zu"])
    return named.select("f_id", "f_end", "z_id", "z_end", "score")


def _linked_session(u: np.ndarray, zh: np.ndarray, size: np.ndarray, code: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the first and of the second language, and score, of the linked and merged sentences of one session."""
    row = np.repeat(np.arange(len(u)), size)
    row, code = row[w[code] > 0], code[w[code] > 0]
    kinds, at = np.unique(code, return_inverse=True)
    holds = np.zeros((len(u), len(kinds)))
    holds[row, at] = 1.0
    rows_f, rows_z, value = np.flatnonzero(~zh), np.flatnonzero(zh), w[kinds].astype(np.float64)
    f, z = holds[rows_f], holds[rows_z]
    common, wf, wz = (f * value) @ z.T, f @ value, z @ value
    i, j = np.nonzero((common > 0) & (common >= CONTAINED * np.minimum(wf[:, None], wz)) & (common >= ALIKE * np.maximum(wf[:, None], wz)))
    weight, tie = common[i, j], _tie(u[rows_f[i]], u[rows_z[j]])
    score = 2 * weight / (wf[i] + wz[j])
    to_z, to_f = np.full(len(rows_f), -1), np.full(len(rows_z), -1)
    taken = np.zeros(len(i), bool)
    order = np.lexsort((u[rows_z[j]], u[rows_f[i]], tie, -score))
    for k, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
        if to_z[a] < 0 and to_f[b] < 0:
            to_z[a], to_f[b], taken[k] = b, a, True
    # A sentence left over joins the linked one whose remaining lexemes make up half of what the two have in common.
    linked = taken.copy()
    for free, partner, mine, theirs, own, other in ((to_z, to_f, i, j, f, z), (to_f, to_z, j, i, z, f)):
        k = np.flatnonzero((free[mine] < 0) & (partner[theirs] >= 0))
        shared = own[mine[k]] * other[theirs[k]]
        n, new = shared.sum(1), (shared * (1 - own[partner[theirs[k]]])).sum(1)
        k = k[(n >= 2) & (new / np.maximum(n, 1) >= 0.5)]
        k = k[np.lexsort((u[rows_z[j[k]]], u[rows_f[i[k]]], tie[k], -weight[k], mine[k]))]
        linked[k[np.unique(mine[k], return_index=True)[1]]] = True
    k = np.flatnonzero(linked)
    return rows_f[i[k]], rows_z[j[k]], score[k]


def linked_in_tasks(lex: DataFrame, weights: np.ndarray) -> DataFrame:
    """f_id, f_end, z_id, z_end, score of linked and merged sentences; each session is linked within one task."""
    shipped = lex.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        rest: pa.Table | None = None

        def done(t: pa.Table):
            """Links the sessions of a table, one after the other."""
            b = t.combine_chunks()
            size = pc.list_value_length(b["lex"]).to_numpy()
            code = pc.list_flatten(b["lex"]).to_numpy().astype(np.int64)
            u, zh, session = b["u"].to_numpy(), b["zh"].to_numpy().astype(bool), pc.dictionary_encode(b["session"]).combine_chunks().indices.to_numpy()
            starts = np.flatnonzero(np.diff(session, prepend=-1))
            ends, before = np.append(starts[1:], len(u)), np.concatenate([[0], np.cumsum(size)])
            out_f, out_z, scores = [], [], []
            for lo, hi in zip(starts.tolist(), ends.tolist()):
                if zh[lo:hi].any() and not zh[lo:hi].all():
                    x, y, s = _linked_session(u[lo:hi], zh[lo:hi], size[lo:hi], code[before[lo] : before[hi]], shipped.value)
                    out_f.append(x + lo)
                    out_z.append(y + lo)
                    scores.append(s)
            if out_f:
                x, y = pa.array(np.concatenate(out_f)), pa.array(np.concatenate(out_z))
                found = pa.table({"f_id": b["id"].take(x), "f_end": b["end_char"].take(x), "z_id": b["id"].take(y), "z_end": b["end_char"].take(y), "score": np.concatenate(scores)})
                yield from found.combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = t["session"][-1]
            n = pc.sum(pc.equal(t["session"], last)).as_py()  # the rows are sorted: the last session may go on
            rest = t.slice(len(t) - n)
            if n < len(t):
                yield from done(t.slice(0, len(t) - n))
        if rest is not None:
            yield from done(rest)

    rows = lex.select("session", "u", "id", "end_char", "zh", "lex").repartition("session").sortWithinPartitions("session")
    return rows.mapInArrow(run, "f_id string, f_end int, z_id string, z_end int, score double")


def aligned(passages: DataFrame, languages: tuple[str, str] = ("fr", "zh"), original_first: bool = True) -> DataFrame:
    """fr_id, fr_end, zh_id, zh_end of sentences of one session that translate each other (named after the default languages).

    original_first: the passage of the first language has the smaller id. Reads id, session_id, language, text_role,
    raw_text. Null ids, sessions, texts and other languages have no part; repeated deliveries count once. Sessions over
    LOCAL sentences are joined by session and two lexemes (one if it makes up much of the sentence) and linked in rounds.
    Without sentences that share names or numbers there is no translation table and no pair.
    """
    plain = passages.where("text_role is null or text_role <> 'edition'")
    spoken = plain.where(F.col("language").isin(*languages) & F.col("session_id").isNotNull())
    both = spoken.groupBy("session_id").agg(F.min("language").alias("a"), F.max("language").alias("b")).where("a <> b").select("session_id", F.lit(True).alias("both"))
    # The sentence model sees the texts of problem 6, so that sentences end where its do; only texts to be aligned are carried along.
    text = F.when(F.col("both") & F.col("language").isin(*languages), F.col("raw_text"))
    gaps = gap_table(plain.select("id", "session_id", "language", "raw_text").join(both, "session_id", "left").withColumn("text", text), "id", "raw_text", "language", ("session_id", "text", "language"))
    sentences = sentence_table(gaps.where("text is not null").drop("begins", "continues").dropDuplicates(["session_id", "id"]), estimate(gaps), languages[1])
    drop_stage(gaps)
    seeds = seed_pairs(sentences)
    lex = lexemes(sentences, translation_table(seeds))
    drop_stage(seeds, sentences)
    weights = weights_of(lex)
    large = stage(lex.groupBy("session").count().where(F.col("count") > LOCAL).select("session"), "large")
    found = linked_in_tasks(lex.join(large, "session", "left_anti"), weights)
    if not large.isEmpty():
        found = found.unionByName(linked_by_rounds(stage(lex.join(large, "session", "left_semi"), "large-lexemes"), weights))
    supported = found.withColumn("n", F.count("*").over(Window.partitionBy("f_id", "z_id"))).where((F.col("n") > 1) | (F.col("score") >= ALONE))
    if original_first:
        supported = supported.where("f_id < z_id")
    return supported.select(F.col("f_id").alias("fr_id"), F.col("f_end").alias("fr_end"), F.col("z_id").alias("zh_id"), F.col("z_end").alias("zh_end"))
