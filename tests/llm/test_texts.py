"""Operators on texts: small fixtures, awkward cases, brute force, exact round trips."""

from __future__ import annotations

import random
import unicodedata
from types import SimpleNamespace

import numpy as np
import pytest

from folioscope.llm import abuse, alignment, canonical, lookalike, mixing, near, scans, sentences, transducer

LONG = "La lettre ancienne répond toujours au miroir fragile du fleuve, dit Quenarville, et personne ne le contredit"
TEXT = "id string, raw_text string, form string, code int"


def texts(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], TEXT)


def disguise(t):
    return t.replace("e", "е").replace(" ", " ").replace("m", "ｍ").replace("é", "é").replace("r", "r​")


# Look-alikes


def test_look_alike_pairs(spark):
    rows = [("b", LONG), ("a", disguise(LONG)), ("a", disguise(LONG)), ("c", LONG), ("d", LONG.replace("é", "e")), ("e", LONG.upper()), ("f", LONG.replace(" ", "  ")), ("g", LONG.replace(",", "\n")), ("h", None), ("i", ""), ("j", "short"), (None, LONG)]
    got = {(r.id_a, r.id_b) for r in lookalike.look_alike_pairs(texts(spark, rows), "id", "raw_text").collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "f"), ("b", "f"), ("c", "f")}


def test_look_alike_empty_and_long(spark):
    assert lookalike.look_alike_pairs(texts(spark, []), "id", "raw_text").count() == 0
    huge = LONG * 2000
    assert [(r.id_a, r.id_b) for r in lookalike.look_alike_pairs(texts(spark, [("a", huge), ("b", disguise(huge))]), "id", "raw_text").collect()] == [("a", "b")]
    forms = {r.id: r.form for r in lookalike.consistent(texts(spark, [("a", None), ("b", ""), ("c", "ﬁn"), ("d", "fin")]), "id", "raw_text").collect()}
    assert forms["a"] is None and forms["b"] == "" and forms["c"] == forms["d"]


def test_confusables_of_unicode(spark):
    found = dict(lookalike.confusables(spark, set("аеоІοԁßéœ中’٥Ӏ𝐚")))
    assert {k: found.get(k) for k in "аеоІοԁ"} == {"а": "a", "е": "e", "о": "o", "І": "I", "ο": "o", "ԁ": "d"}
    assert not {"’", "中", "ß", "œ", "é"} & set(found)


def test_a_missing_table_of_confusables_is_no_result(spark, monkeypatch):
    rows = texts(spark, [("a", LONG), ("b", LONG.replace("o", "\U0001d5c8"))])
    for gone in (SimpleNamespace(), SimpleNamespace(_sc=None), SimpleNamespace(_sc=SimpleNamespace(_jvm=None)), SimpleNamespace(_sc=SimpleNamespace(_jvm=spark._jvm.no.such.place))):
        with pytest.raises(RuntimeError, match="confusable"):
            lookalike.confusables(gone, {"\u0430"})
        assert lookalike.confusables(gone, {"a", " ", "\u4e2d"}) == []  # nothing to ask for
    asked = lookalike.confusables
    monkeypatch.setattr(lookalike, "confusables", lambda session, symbols: asked(SimpleNamespace(), symbols))
    with pytest.raises(RuntimeError, match="confusable"):
        lookalike.look_alike_pairs(rows, "id", "raw_text")


def test_copies_of_one_form_are_not_compared(spark):
    rows = [(f"c{i}", LONG) for i in range(30)] + [("d", disguise(LONG)), ("e", LONG.replace("a", "а"))]
    got = {(r.id_a, r.id_b) for r in lookalike.look_alike_pairs(texts(spark, rows), "id", "raw_text").collect()}
    assert len(got) == 30 * 2 + 1 and ("d", "e") in got
    classes = lookalike.look_alike_members(texts(spark, rows), "id", "raw_text").collect()
    assert len(classes) == 32 and len({r["class"] for r in classes}) == 1 and len({r.text for r in classes}) == 3


def test_classes_are_transitive():
    classes = lookalike.look_alike_classes([("a", "b"), ("b", "c"), ("x", "")], {"c": 9, "a": 1})
    assert classes == {"a": "c", "b": "c", "x": ""}
    form = lookalike.rewriter(lookalike.look_alike_classes(lookalike.relations(set(disguise(LONG))), {}))
    assert form(disguise(LONG)) == unicodedata.normalize("NFC", LONG)


# Near duplicates


def similarity(a, b):
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    a, b = grams(near.skeleton(a)), grams(near.skeleton(b))
    return len(a & b) / len(a | b)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"mot{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(25)]
        for v in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(v * 2):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((f"{k:02d}{v}", " ".join(t)))
    rows += [("copy", rows[0][1].upper()), ("null", None), ("none", ""), (None, rows[0][1]), (*rows[1],)]
    got = {(r.id_a, r.id_b) for r in near.near_duplicate_pairs(texts(spark, rows), "id", "raw_text").collect()}
    kept = dict((i, t) for i, t in rows if i and t)
    want = {(a, b) for a in kept for b in kept if a < b and similarity(kept[a], kept[b]) >= near.SIMILARITY}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 30


def test_near_duplicates_far_down(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 2)
    draw = random.Random(5)
    base, rows = [draw.randrange(10**6) for _ in range(60)], []
    for k in range(240):
        own = [w if draw.random() < 0.85 else draw.randrange(10**6) for w in base]
        rows.append((f"{k:03}", " ".join(f"mot{w:06}" for w in own)))
    kept = dict(rows)
    want = {(a, b) for a in kept for b in kept if a < b and 0.6 <= similarity(kept[a], kept[b]) < 0.65}
    got = {(r.id_a, r.id_b) for r in near.near_duplicate_pairs(texts(spark, rows), "id", "raw_text").collect()}
    assert len(want) > 300 and len(want & got) >= 0.95 * len(want)
    assert near.runs_for(3) < near.runs_for(4) < near.runs_for(8)


def test_runs_reach_their_recall():
    draw, pairs = np.random.default_rng(4), 3000
    a = draw.integers(0, 2**63, (pairs, near.COORDINATES), np.uint64)
    b = np.where(draw.random(a.shape) < near.SIMILARITY, a, draw.integers(0, 2**63, a.shape, np.uint64))
    met = np.zeros(pairs, bool)
    for done in range(0, near.runs_for(3), 10):
        one, two = (near.first_paths(s, min(done + 10, near.runs_for(3)), done=done) for s in (a, b))
        common = set(zip(*(x.tolist() for x in one))) & set(zip(*(x.tolist() for x in two)))
        met[[o for o, _ in common]] = True
    assert near.RECALL - 0.015 <= met.mean() <= 0.995


def test_sketches_keep_similar_short_texts():
    draw, missed, n = random.Random(2), 0, 4000
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    a, b = [], []
    for _ in range(n):
        common, ends = draw.choices(letters, k=38), [draw.choices(letters, k=11) for _ in range(2)]
        a.append("".join(common + ends[0]))  # 45 sequences, 34 of them common: similarity 34/56
        b.append("".join(common + ends[1]))
    most = [near.most_different(near._signatures(s)[1]) for s in (a, b)]
    for x, y, m, k in zip(zip(*near.sketches(near.signatures(a))), zip(*near.sketches(near.signatures(b))), *most):
        missed += sum(((int(p) ^ int(q)) & (2**64 - 1)).bit_count() for p, q in zip(x, y)) > max(m, k)
    assert missed <= 0.002 * n


def test_near_duplicates_of_one_cluster(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 8)
    rows = [(f"{i:02d}", f"{LONG} variante numéro {i}") for i in range(30)]
    assert near.near_duplicate_pairs(texts(spark, rows), "id", "raw_text").count() == 30 * 29 // 2
    assert near.near_duplicate_pairs(texts(spark, []), "id", "raw_text").count() == 0
    classes = near.near_duplicate_classes(texts(spark, rows + [("99", rows[0][1])]), "id", "raw_text").collect()
    assert {r.links for r in classes} == {29} and len(classes) == 31


# Tokenizer


@pytest.fixture(scope="module")
def merges():
    return transducer.load_merges()


def test_encoding_matches_the_library(merges):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rng, machine = random.Random(1), transducer.Transducer(merges)
    samples = ["", " ", "<|endoftext|>", "a" * 3000, " " * 700 + "x", "不" * 2000, LONG, disguise(LONG)]
    samples += ["".join(rng.choice("ab é\n\t'sré不的　\x1c\x85\U0001f600​17") for _ in range(rng.randrange(120))) for _ in range(400)]
    samples.append("".join(chr(rng.randrange(97, 123)) for _ in range(6000)))
    for t in samples:
        ids = machine.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids, t[:80]
        assert transducer.decode(ids, merges) == t


def test_stable_tokens_leave_early(merges):
    machine = transducer.Transducer(merges)
    stream = machine.encode_bytes(b"abc" * 5000)
    first = next(stream)
    assert [first, *stream] == list(transducer.Transducer(merges).encode_bytes(b"abc" * 5000))
    assert merges.lookahead == 128


def test_corpus_encoding(spark):
    df = spark.createDataFrame([(1, "déjà", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "x", 5)], "doc_id long, text string, ids int")
    got = transducer.encode_corpus(df, "doc_id", "text")
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    rows = sorted((r.doc_id or 0, len(r.ids)) for r in got.collect())
    assert rows[0] == (0, 1) and rows[1][1] > 0 and [n for i, n in rows if i in (2, 3)] == [0, 0, 0]
    assert transducer.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


# Mixing


def test_mixture(spark):
    rows = [(i, "mot " * (20 + i % 7), "big" if i % 3 else "small", None) for i in range(300)] + [(900, None, "big", None), (901, "", "small", None), (902, "x", None, None), (903, "y", "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed, planned = mixing.mixture(docs, targets, block=16, shard=32)
    report = {r.source: r for r in mixing.mixture_report(mixed, planned).collect()}
    assert report["absent"].tokens == 0 and report["big"].most_repeats == 1 and report["small"].most_repeats <= 3
    assert abs(report["big"].tokens / report["small"].tokens - 0.5 / 0.4) < 0.05
    assert mixed.groupBy("shard").count().where("count > 32").count() == 0
    again = mixing.mixture(docs, targets, block=16, shard=32)[0]
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    assert mixing.mixture(docs.limit(0), targets)[0].count() == 0


def test_packing_keeps_every_token(spark):
    ids = spark.createDataFrame([(i, "s", list(range(i % 50))) for i in range(200)], "doc_id long, source string, ids array<int>")
    blocks = mixing.pack(ids, {"s": 196}, 16, 64).collect()
    assert sum(r.n for r in blocks) == sum(i % 50 for i in range(200)) and sorted(r.block for r in blocks) == list(range(len(blocks))) and max(r.n for r in blocks) == 16


def test_shards_are_drawn_alike_by_every_task():
    slots = np.array([5000, 130, 0, 20_017])
    counts, starts = mixing.draw_shards(slots, 0, 393, 64)
    assert (counts.sum(0) == slots).all() and (counts[:-1].sum(1) == 64).all() and (starts == np.cumsum(counts, 0) - counts).all()
    for first, last in ((0, 1), (100, 200), (392, 393)):
        part, before = mixing.draw_shards(slots, first, last, 64)
        assert (part == counts[first:last]).all() and (before == starts[first:last]).all()
    spread = counts[:-1, 0].std() / np.sqrt(64 * 0.2 * 0.8)
    assert 0.8 < spread < 1.2  # as draws spread, not in equal parts
    huge = np.array([6_000_000_000, 3_999_999_000, 1000])
    some, _ = mixing.draw_shards(huge, 5_000_000, 5_000_003, 1024)
    assert (some.sum(1) == 1024).all() and abs(some[:, 0].mean() - 614) < 80


def test_token_totals_count_every_row(spark):
    df = spark.createDataFrame([(1, "déjà", "a"), (1, "vu", "a"), (None, "", None)], "doc_id long, text string, source string")
    assert sorted((r.source or "", r.documents, r.restored) for r in transducer.token_totals(df, "source").collect()) == [("", 1, 1), ("a", 2, 2)]


def test_permutation():
    for n in (1, 2, 7, 100, 1000):
        x = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(x) == list(range(n))


# Canonical values


SPEC = "id string, canonical_name string, fr string, en string, zh string, aliases array<string>, context_required_aliases array<string>, entity_id string"


def test_mapping(spark):
    spec = spark.createDataFrame([
        ("e1", "common ship ", "navire commun", "common ship", "共同船只", ["navires communs", "", None], ["navire"], None), ("e2", "living river", "fleuve vivant", "living river", "活着河流", None, None, None),
        ("e3", "motionless silence", "silence immobile", None, None, [], [], None), (None, "nobody", None, None, None, None, None, None), ("e4", "movable mirror", "miroir mobile", None, None, None, None, None),
    ], SPEC)
    values = ["Navire_commun", "ship common", "navire comn.", "ｆｌｅｕｖｅ ｖｉｖａｎｔ", "« 活着河流 »", "navire", "silence mobile", "fleuve commun", "Vaudrezande ?", None, "", "   ", "la notion : FleuveVivant", "fleuvee vivnt", "navires communs, voir L9", "x" * 20_000, "silеnce іmmobile", "navire fragile"]
    entries = spark.createDataFrame([(i, v, "e9") for i, v in enumerate(values)] + [(0, values[0], "e9")], "entry_id long, entered string, entity_id string")
    rows = canonical.map_values(entries, spec).collect()
    assert len(rows) == len(values) + 1
    got = {r.entry_id: r.entity_id for r in rows}
    assert [got[i] for i in range(len(values))] == ["e1", "e1", "e1", "e2", "e2", "", "", "", "", "", "", "", "e2", "e2", "e1", "", "e3", ""]
    assert {r.entity_id for r in canonical.map_values(entries, spec.limit(0)).collect()} == {""}
    assert canonical.map_values(entries.limit(0), spec).count() == 0


def test_unmatched_values_are_counted_by_row(spark):
    spec = spark.createDataFrame([("e1", "navire commun", None, None, None, None, None, None)], SPEC)
    entries = spark.createDataFrame([(1, "rien"), (1, "rien"), (None, "rien"), (2, "navire commun"), (3, None)], "entry_id long, entered string")
    assert {(r.entered, r.n) for r in canonical.unmatched_report(canonical.map_values(entries, spec, carry=("entered",))).collect()} == {("rien", 3), (None, 1)}


def test_words_that_were_cut_off():
    found = canonical.Resolver([("a", "jardin mobile"), ("b", "jardinier mobile"), ("c", "fleuve vivant")])
    assert found.resolve(("jardin", "mob")) == "a" and found.resolve(("fleuve", "viv")) == "c" and sorted(found._begun("jard")) == ["jardin", "jardinier"]


def test_changes():
    assert [canonical.changes(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xyz"))] == [0, 1, 1, 3]


# Scanned pages


def pages(spark):
    clean = ["Le miroir ancien répond toujours au fleuve. " * 3 + "La lettre oblique demeure ici, dit le jardinier, au-delà du mur."] * 40
    page = "ÉDITIONS DU FLEUVE\nLe miroir ancien répond tou-\n- 12 -\njours au fleuve, et la lettre 0blique demeurc ici, au-\ndelà du mur que le jardinier regarde sans bruit.\n13"
    rows = [(f"t{i:02d}", t, "transcription") for i, t in enumerate(clean)] + [("p", page, "edition"), ("p", page, "edition"), ("n", None, "edition"), ("e", "", "edition"), (None, page, "edition")]
    return spark.createDataFrame([(*r, 1) for r in rows], "id string, raw_text string, text_role string, line int")


def test_noise_places(spark):
    df = pages(spark)
    got = {(r.line_no, r.kind, r.fixed) for r in scans.noise_places(df.where("text_role = 'edition'"), df).collect() if r.id == "p"}
    assert got == {(1, "header", ""), (2, "hyphen", "toujours"), (3, "page_no", ""), (4, "char", "oblique"), (4, "char", "demeure"), (6, "page_no", "")}
    text = {r.id: r.text for r in scans.readable(df.where("text_role = 'edition'"), df).collect()}
    assert text["p"] == "Le miroir ancien répond toujours au fleuve, et la lettre oblique demeure ici, au-delà du mur que le jardinier regarde sans bruit."
    assert scans.noise_places(df.limit(0), df.limit(0)).count() == 0


def test_readable_replaces_whole_words(spark):
    rows = [(f"t{i}", "Le mur ancien tient, le fleuve dort et le jardin reste ouvert ici.", "transcription") for i in range(20)]
    page = "Le rnur ancien tient, le fleuve d0rt et le grnur reste 0uvert ici; le fleuve d0rtoir.\nLe mur ancien tient, le fleuve dort et le jardin reste ouvert ici."
    df = spark.createDataFrame([*rows, ("p", page, "edition")], "id string, raw_text string, text_role string")
    text = {r.id: r.text for r in scans.readable(df.where("text_role = 'edition'"), df).collect()}["p"]
    assert text.startswith("Le mur ancien tient, le fleuve dort et le grnur reste ouvert ici; le fleuve d0rtoir.")


# Sentences


def test_sentence_ends(spark):
    fr = ["Le mur tient. La porte ferme ! M. Dupont lit, p. 12, le n° 3. Voici « Où est-il ? » sans réponse. Fin", "Reprise\nLe fleuve dort.  Il y a 3.5 m. Le mur tient.", None, "", "  \n ", "Bien."]
    zh = ["墙很高。门开了！他写道：‘在哪里？’却没有下文。第3.5节谈到墙。", "墙很高 门开了 他走了", "墙很高\n门开了"]
    rows = [(f"f{i}", t, "fr", i) for i, t in enumerate(fr)] + [(f"z{i}", t, "zh", i) for i, t in enumerate(zh)] + [("f5", "Bien.", "fr", 9), (None, "Rien.", "fr", 9), ("n", "Un mot. Deux mots.", None, 1)]
    more = [(f"m{i}", "Le mur tient. La porte ferme. Le fleuve dort. Il y a un mur. Voici la fin.", "fr", 1) for i in range(30)] + [(f"y{i}", "墙很高。门开了。他走了。\n门开了。", "zh", 1) for i in range(30)]
    df = spark.createDataFrame(rows + more, "id string, raw_text string, language string, kind int")
    out = sentences.sentence_ends(df).collect()
    assert len({(r.id, r.end_char) for r in out}) == len(out)
    cut = {}
    for r in sorted(out, key=lambda r: r.end_char):
        t = next(x[1] for x in rows + more if x[0] == r.id)
        done = sum(map(len, cut.get(r.id, [])))
        cut.setdefault(r.id, []).append(t[done : r.end_char])
    assert [s.strip() for s in cut["f1"]][:2] == ["Reprise", "Le fleuve dort."] and cut["f5"] == ["Bien."]
    assert [s.strip() for s in cut["f0"]][:2] == ["Le mur tient.", "La porte ferme !"] and cut["f0"][-1].strip().endswith("Fin")
    assert cut["z0"][:2] == ["墙很高。", "门开了！"] and len(cut["z2"]) == 2 and len(cut["z1"]) == 3
    assert not {"f2", "f3", "f4"} & set(cut)
    assert sentences.sentence_ends(df.limit(0)).count() == 0


def test_posteriors_of_a_long_text_pad_no_other():
    import tracemalloc

    draw = np.random.default_rng(1)
    model = sentences.Model(*(draw.random((2, n)).astype(np.float32) for n in (sentences.WORDS, sentences.SHAPES, sentences.WORDS, sentences.SHAPES, sentences.MARKS, 2 * sentences.LENGTHS)))
    size = np.array([3, 0, 50_000, *[5] * 2000])
    n = int(size.sum())
    gaps = [np.concatenate([np.arange(1, k + 1) * 20 for k in size]), draw.integers(0, 5, n), *(draw.integers(0, 64, n) for _ in range(5))]
    tracemalloc.start()
    post, cls = sentences.posteriors(model, size, *gaps)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    at = 3  # one text gives the same by itself
    alone, _ = sentences.posteriors(model, size[2:3], *(g[at : at + 50_000] for g in gaps))
    assert np.allclose(post[at : at + 50_000], alone, atol=1e-5) and ((0 <= post) & (post <= 1)).all()


# Alignment


def test_alignment(spark):
    rng = random.Random(5)
    nouns = dict(zip("mur porte fleuve miroir lettre jardin lampe bateau pierre arbre".split(), "城墙 大门 河流 镜子 书信 花园 灯笼 船只 石头 树木".split()))
    verbs = dict(zip("regarde cache porte_ touche mesure efface".split(), "看见 隐藏 搬运 触摸 衡量 抹去".split()))
    rows = []
    for s in range(40):
        said = [(rng.choice(list(nouns)), rng.choice(list(verbs)), rng.choice(list(nouns)), 100 + rng.randrange(800), f"Quen{rng.choice('abcdefgh')}r{rng.choice('aeiou')}lande") for _ in range(5)]
        fr = [f"Selon {n}, le {a} {v.strip('_')} toujours le {b} en {y}." for a, v, b, y, n in said]
        zh = [f"按照{n}的说法，{nouns[a]}在{y}年{verbs[v]}了{nouns[b]}。" for a, v, b, y, n in said]
        order = rng.sample(range(5), 5)
        rows += [(f"p{s:02d}a", f"s{s}", "fr", "transcription", " ".join(fr)), (f"p{s:02d}b", f"s{s}", "zh", "translation", "".join(zh[i] for i in order[:4]))]
    rows += [("x", None, "fr", None, "Rien."), ("y", "s1", None, None, "Rien."), ("z", "s1", "zh", None, None), rows[0]]
    schema = "id string, session_id string, language string, text_role string, raw_text string, u long, zh int"
    df = spark.createDataFrame([(*r, None, None) for r in rows], schema)
    got = alignment.aligned(df).collect()
    text = {r[0]: r[4] for r in rows}
    part = lambda t, e: t[: e].rstrip("。.").replace("。", ".").split(".")[-1]
    right = sum(part(text[r.fr_id], r.fr_end).strip().split(",")[0].removeprefix("Selon ") == part(text[r.zh_id], r.zh_end).split("的说法")[0].removeprefix("按照") for r in got)
    assert len(got) >= 120 and right >= 0.95 * len(got)
    assert len({tuple(r) for r in got}) == len(got)
    assert alignment.aligned(df.limit(0)).count() == 0


# Abuse


def test_abuse(spark):
    rng = random.Random(2)
    calm = ["le mur tient bon", "la porte ferme bien", "le fleuve dort encore", "une lettre arrive ici", "le rapport cite un mot sale et le condamne"]
    foul = ["tu es un sale crétin et tout le monde le sait", "va donc pourrir dans ton trou sale crétin", "ferme la pauvre crétin puant"]
    rows, labels, truth = [], [], {}
    for i in range(400):
        bad = i % 8 == 0
        said = [rng.choice(calm) for _ in range(5)] + ([rng.choice(foul)] if bad else [])
        rng.shuffle(said)
        rows.append((i, ". ".join(said) + ".", "s" + str(i % 3), 1))
        truth[i] = bad
        if i % 2 == 0:
            labels.append((i, "abusive" if bad else "ok"))
    rows += [(1000, None, "s0", 1), (1001, "", "s0", 1), (1002, "Tu es un sаlе crrrétin, et t o u t le monde le sait.", "s1", 1), (1003, "mot " * 30_000, "s1", 1)]
    labels += [(0, None), (2, "abusive"), (2, "ok"), (None, "ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, label string")
    got = {r.doc_id: r for r in abuse.score_documents(docs, marks).collect()}
    assert len(got) == len(rows)
    held = [i for i in truth if i % 2]
    assert sum(got[i].found == truth[i] for i in held) >= 0.98 * len(held) and sum(got[i].found == truth[i] for i in truth) >= 0.98 * len(truth)
    assert got[1002].found and not got[1000].found and got[1001].score == 0 and not got[1003].found
    assert not any(r.found for r in abuse.score_documents(docs, marks.limit(0)).collect())
    assert abuse.score_documents(docs.limit(0), marks).count() == 0


def test_threshold_uses_every_labelled_document(spark, monkeypatch):
    rng = random.Random(7)
    calm, foul = ["le mur tient bon", "la porte ferme bien", "une lettre sale arrive ici", "le jardin dort encore"], ["tu es un sale crétin", "sale crétin puant", "va pourrir crétin"]
    rows = [(i, ". ".join(rng.choice(calm) for _ in range(4)) + (". " + ". ".join(rng.choice(foul) for _ in range(rng.randrange(1, 4))) if i % 5 == 0 else "")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judged = spark.createDataFrame([(i, (i % 5 == 0) != (i % 31 == 0)) for i, _ in rows], "doc_id long, abusive boolean")
    seen, maxima = [], abuse._maxima

    def watched(rows, weights):
        seen.append(rows.count())
        return maxima(rows, weights)

    monkeypatch.setattr(abuse, "_maxima", watched)
    monkeypatch.setattr(abuse, "CALIBRATE", 24, raising=False)  # no such bound holds
    got = abuse.fit(abuse._token_table(docs, "doc_id", "text"), judged)
    assert set(seen) == {240} and got.least >= abuse.SIGNIFICANT and got.decay > 0


def test_laws_and_threshold_against_brute_force(spark):
    draw, n = np.random.default_rng(5), 4000
    part, abusive = draw.integers(0, 4, n), draw.random(n) < 0.15
    size = np.where(draw.random(n) < 0.05, 0, draw.integers(1, 60, n))
    score = np.where(draw.random(n) < 0.6, 0.0, np.rint(draw.gumbel(6 + 8 * abusive, 2) * 4) / 4)  # most are equal
    score, size = np.where(size > 0, score, 0.0), np.where((part == 3) & ~abusive, 0, size)  # part 3 has no harmless one
    rows = [(int(p), bool(a), float(s), int(k)) for p, a, s, k in [*zip(part, abusive, score, size), *zip(np.full(n, -1), abusive, score + 0.25, size)]]
    want, bits = {}, np.zeros(n)
    for p in range(-1, 4):
        of = np.array([r[1:] for r in rows if r[0] == p], float)
        fine = of[(of[:, 0] == 0) & (of[:, 2] > 0)] if p < 3 else of
        low = np.sort(fine[:, 1])[: int(len(fine) * 0.9)]
        decay = float(np.clip(np.pi / np.sqrt(6) / max(low.std() * 1.2, 1e-3), 0.2, 2.0))
        want[p] = decay, float(np.median(decay * fine[:, 1] - np.log(np.maximum(fine[:, 2], 1)))) + np.log(np.log(2))
        if p >= 0:
            bits[part == p] = decay * of[:, 1] - want[p][1] - np.log(np.maximum(of[:, 2], 1))
    cuts = np.unique(bits)[::-1]
    f1 = np.array([2 * abusive[bits >= c].sum() / ((bits >= c).sum() + abusive.sum()) for c in cuts])
    at = int(np.argmax(f1 >= f1.max() - abuse.SLACK * np.sqrt(f1.max() * (1 - f1.max()) / abusive.sum())))
    assert 0 < at < len(cuts) - 1
    got = []
    for tasks in (1, 7):
        maxima = spark.createDataFrame(rows, "part int, abusive boolean, score double, n int").repartition(tasks)
        laws = abuse._laws(maxima)
        got.append((laws, abuse._threshold(maxima, laws)))
    assert got[0] == got[1]  # to the last bit
    assert all(np.allclose(got[0][0][p], want[p]) for p in want) and np.isclose(got[0][1], (cuts[at] + cuts[at + 1]) / 2)


def test_rates_count_every_row(spark):
    scored = spark.createDataFrame([(1, "a", True), (1, "a", False), (None, "a", False), (2, None, True)], "doc_id long, source string, found boolean")
    assert sorted((r.source or "", r.documents, r.n_found) for r in abuse.rates(scored).collect()) == [("", 1, 1), ("a", 3, 1)]


def test_segments_in_linear_time():
    import time

    took = []
    for n in (40_000, 160_000):
        s = np.where(np.arange(n) % 2, -2.0, 1.0)  # every segment stands alone, none lower than the last
        start = time.process_time()
        assert len(abuse.maximal_segments(s)) == n // 2
        up = np.where(np.arange(n) % 2, -1.0, 1.5)[::-1]
        abuse.maximal_segments(up)
        took.append(time.process_time() - start)
    assert took[1] < 10 * max(took[0], 0.02)


def test_masked_words():
    lexicon = {("c", 6): ["cretin", "catins"], ("c", 5): ["chien"]}
    assert [abuse._unmask(w, lexicon, {}) for w in ("cr*tin", "c*t*ns", "ch**n", "z*z", "cr**")] == ["cretin", "catins", "chien", "z*z", "cr**"]


def maximal(s, lo, hi):
    """The best segment, then those to its left and right."""
    sums = [(s[a:b].sum(), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
    top, i, j = max(sums, key=lambda x: (x[0], x[1] - x[2]), default=(0, 0, 0))
    return [*maximal(s, lo, i), (i, j), *maximal(s, j, hi)] if top > 0 else []


def test_segments_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(-0.3, 1, rng.integers(1, 14))
        top, i, j = abuse.best_segment(s)
        want = max([0.0] + [s[a:b].sum() for a in range(len(s)) for b in range(a + 1, len(s) + 1)])
        assert abs(top - want) < 1e-9 and abs(s[i:j].sum() - top) < 1e-9
        parts = abuse.maximal_segments(s)
        assert all(b <= c for (_, _, b), (_, c, _) in zip(sorted(parts, key=lambda x: x[1]), sorted(parts, key=lambda x: x[1])[1:]))
        assert not parts or abs(max(x for x, _, _ in parts) - want) < 1e-9
        assert sorted((i, j) for _, i, j in parts) == sorted(maximal(s, 0, len(s)))


def test_all_alike_sentences_share_a_key():
    draw = random.Random(3)
    w = np.zeros(2 * alignment.WORDS, np.float32)
    w[:60] = [draw.uniform(0.3, 9) for _ in range(60)]
    w[60:64] = 4
    rows = [[60], [60, 61], [60, 61, 62], [61, 62], *(draw.sample(range(60), draw.randint(1, 14)) for _ in range(500))]
    row, code = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([x for r in rows for x in r])
    owner, keys = alignment.rare_keys(row, code, w, np.full(len(rows), 7, np.uint64))
    held = [set() for _ in rows]
    for o, k in zip(owner.tolist(), keys.tolist()):
        held[o].add(k)
    heavy = [float(w[r].sum()) for r in rows]
    alike = 0
    for i in range(len(rows)):
        for j in range(i):
            common = float(w[list(set(rows[i]) & set(rows[j]))].sum())
            if common >= alignment.CONTAINED * min(heavy[i], heavy[j]) and common >= alignment.ALIKE * max(heavy[i], heavy[j]):
                alike += 1
                assert held[i] & held[j], (rows[i], rows[j])
    assert alike > 50


def test_sessions_are_linked_alike_in_tasks_and_by_rounds(spark):
    rng = random.Random(8)
    w = np.zeros(2 * alignment.WORDS, np.float32)
    w[:80] = [round(rng.uniform(0.3, 9) * 1024) / 1024 for _ in range(80)]
    rows = []
    for s in range(30):
        for k in range(rng.randrange(1, 16)):
            lex = rng.sample(range(80), rng.randint(1, 9))
            rows.append((f"s{s}", f"f{k:02}", 10, False, lex))
            for part in range(rng.randrange(3)):
                rows.append((f"s{s}", f"z{k:02}", 10 + part, True, [x for x in lex if rng.random() < 0.7] or lex))
    lex = spark.createDataFrame(rows, "session string, id string, end_char int, zh boolean, lex array<int>").selectExpr("xxhash64(session, id, end_char) AS u", "*")
    said = [sorted(map(tuple, alignment.linked_in_tasks(lex.repartition(n), w).collect())) for n in (2, 16)]
    assert said[0] == said[1] == sorted(map(tuple, alignment.linked_by_rounds(lex, w).collect())) and len(said[0]) > 150


def test_equal_sentences_are_linked_in_few_rounds(spark, monkeypatch):
    stages, real = [], alignment.stage
    monkeypatch.setattr(alignment, "stage", lambda df, name: (stages.append(name), real(df, name))[1])
    n = 60
    pairs = spark.range(n * n).selectExpr(f"id DIV {n} AS fu", f"id % {n} AS zu", "1D AS common", "1D AS wf", "1D AS wz", "xxhash64(id) AS tie")
    taken = alignment.link(pairs).collect()
    assert len(taken) == n == len({r.fu for r in taken}) == len({r.zu for r in taken}) and stages.count("linked") <= 12


def test_seeds_of_a_frequent_name_keep_to_the_order(spark):
    rows = [("s", f"{k:03}{'z' if zh else 'f'}", 5, zh, [1 << 20, (1 << 20) + 1], [k]) for k in range(40) for zh in (False, True)] + [("s", "999f", 5, False, [1 << 20, (1 << 20) + 1], [999])]
    got = [(r.f[0], r.z[0]) for r in alignment.seed_pairs(spark.createDataFrame(rows, "session string, id string, end_char int, zh boolean, anchors array<int>, words array<int>")).collect()]
    assert len(got) == 41 and max(abs(f - z) for f, z in got if f < 999) <= 1


def test_translations_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [([rng.randrange(200) for _ in range(8)], [300 + rng.randrange(200) for _ in range(8)]) for _ in range(300)] + [([k % 50, rng.randrange(200)], [300 + k % 50, 300 + rng.randrange(200)]) for k in range(600)]
    seeds = spark.createDataFrame(rows, "f array<int>, z array<int>")
    one, two = (alignment.translation_table(seeds.repartition(n)) for n in (2, 16))
    assert (one == two).all() and (one >= 0).sum() > 20


def test_alignment_estimates_sentences_on_all_texts(spark, monkeypatch):
    seen, real = set(), alignment.estimate

    def estimate(gaps):
        seen.update(r.id for r in gaps.select("id").collect())
        return real(gaps)

    monkeypatch.setattr(alignment, "estimate", estimate)
    rows = [("a", "s", "fr", None, "Le miroir tombe. Il pleut."), ("b", "s", "zh", None, "镜子掉了。下雨了。"), ("c", "t", "fr", None, "Une lettre. Une autre."), ("d", None, "en", None, "One letter. Another."), ("e", "t", "fr", "edition", "Une note. Une autre.")]
    alignment.aligned(spark.createDataFrame(rows, "id string, session_id string, language string, text_role string, raw_text string")).count()
    assert seen == {"a", "b", "c", "d"}


@pytest.mark.parametrize("name", ["p4_found", "p7_found"])
def test_oracle(spark, name):
    import glob
    import os

    import duckdb

    from folioscope.llm import catalogue

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    query, sql = ({k: x for m in catalogue.modules() for k, x in getattr(m, what)().items()}[name] for what in ("queries", "oracle_sql"))
    assert sorted((r.id_a, r.id_b) for r in query(spark, folder).collect()) == sorted(con.sql(sql).fetchall())
