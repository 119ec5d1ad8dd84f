"""The training-data operators against brute force, exact round trips and held-out rows, on small inputs with the awkward cases."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, common, decontam, exact, html, langid, lm, mixing, near, pii, quality
from lodestone.llm.tokens import words_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, body string, sha string, row string"


def docs_of(spark, rows):
    """doc_id, text and columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z") for i, t in rows], DOCS)


AWKWARD = [(1, None), (2, ""), (3, "same text"), (4, "same text"), (4, "same text"), (5, "Same text"), (6, "word " * 20_000), (None, "same text"), (7, " \t\n ")]


def everything(df):
    return df.collect()


# exact


def test_exact_groups(spark):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in everything(exact.exact_groups(docs_of(spark, AWKWARD)))}
    assert {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 4, False), (4, 4, 4, True), (None, 4, 4, False), (5, 5, 1, True), (7, 7, 1, True), (6, 6, 1, True)} == got
    kept = exact.keep_one(docs_of(spark, AWKWARD))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [2, 4, 5, 6, 7] and kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert exact.exact_groups(docs_of(spark, AWKWARD).limit(0)).count() == 0
    sha = {r["doc_id"]: r["text_sha256"] for r in everything(exact.exact_groups(docs_of(spark, [(9, "é")])))}
    assert sha == {9: hashlib.sha256("é".encode()).hexdigest()}


def test_exact_keeps_rows_not_ids(spark):
    for rows, want in (
        ([(5, "dup"), (9, "dup"), (5, "unique text")], {(9, "dup"), (5, "unique text")}),
        ([(5, "a"), (1, "a"), (5, "b"), (2, "b")], {(5, "a"), (5, "b")}),
        ([(None, "a"), (3, "a"), (None, "b"), (None, "c"), (None, "c")], {(3, "a"), (None, "b"), (None, "c")}),
        ([(7, "x"), (7, "x"), (7, None), (7, "")], {(7, "x"), (7, None)}),
    ):
        got = [(r["doc_id"], r["text"]) for r in exact.keep_one(docs_of(spark, rows)).collect()]
        assert len(got) == len(want) and {(i, t or None) for i, t in got} == want
    assert exact.keep_one(docs_of(spark, AWKWARD).limit(0)).count() == 0


def test_hot_keys_meet_apart(spark, monkeypatch):
    """Keys of many rows take the broadcast way, with the same result."""
    rows = [(i, "hot" if i % 3 else f"own {i}") for i in range(6000)]
    groups = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(docs_of(spark, rows)).collect()}
    assert groups == {(i, 5999 if i % 3 else i, 4000 if i % 3 else 1, i == 5999 or not i % 3) for i, _ in rows}


# chat


def test_chat_round_trip():
    texts = ["", "\\", "</turn>", "### user: x </turn>\n", "a\\</turn>\n### assistant: b", "é\n\n", "#<\\:"]
    conversation = chat.Conversation()
    for i, t in enumerate(texts * 2):
        conversation.apply("message", "", ["user", "assistant", "a:b\n"][i % 3], t)
    formatted, starts, ends = conversation.render()
    turns = chat.parse(formatted)
    assert [t for _, t in turns] == texts * 2 and turns[2][0] == "a:b\n"
    assert [chat.unescape(formatted[a:b]) for a, b in zip(starts, ends, strict=True)] == [t for r, t in turns if r == "assistant"]


def test_chat_events(spark):
    log = [
        (1, 0, "message", 1, "user", "hi"), (1, 2, "delta", 2, None, "lo"), (1, 1, "message", 2, "assistant", "hel"), (1, 3, "message", 3, "user", "later"),
        (1, 4, "regenerate", 2, None, None), (1, 5, "delta", 2, None, "new"), (1, 6, "edit", 1, None, "hey"), (2, None, "message", None, None, None), (None, 1, "message", 1, "user", "x"),
    ]
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in everything(chat.format_chats(spark.createDataFrame(log, chat.EVENT)))}
    assert got == {1: [("user", "hey"), ("assistant", "new")], 2: [("", "")], None: [("user", "x")]}
    assert chat.format_chats(spark.createDataFrame([], chat.EVENT)).count() == 0
    odd = [(1, 0, "message", 1, "user", "hi"), (1, 1, "reaction", 1, "user", "!"), (2, 0, None, None, None, None), (1, 0, "message", 1, "user", "hi")]
    got = {r["conv_id"]: r["formatted"] for r in everything(chat.format_chats(spark.createDataFrame(odd, chat.EVENT)))}
    assert chat.parse(got[1]) == [("user", "hi")] and got[2] == ""


# language


def test_language(spark):
    docs = common.table(spark, SF, "documents")
    found = {r["doc_id"]: r for r in everything(langid.op10_language_id(spark, SF))}
    held = [(r["lang"], found[r["doc_id"]]["lang_pred"]) for r in docs.collect() if found[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.96 * len(held) and len(found) == docs.count()
    dictionaries = langid.fit(docs)
    coder = langid.Coder(dictionaries)
    assert [coder.predict(t) for t in (None, "", "123 !?", " ")] == [("und", 0.0, True)] * 4
    assert langid.Coder({}).predict("text") == ("und", 0.0, True) and langid.Coder({"en": dictionaries["en"]}).predict("text") == ("en", 1.0, False)
    assert [r["doc_id"] for r in langid.accepted(docs_of(spark, [(1, None), (2, "the thing that was of the ering and")]), dictionaries).collect()] == [2]
    empty = langid.predict(docs_of(spark, AWKWARD).limit(0), langid.fit(docs.limit(0)))
    assert empty.count() == 0 and langid.fit(docs.limit(0)) == {}


def plain_prediction(text, dictionaries):
    """The same by one coder call a window and language, without precomputed tables."""
    import zstandard as zstd

    data = langid.letters(text)
    sizes = {}
    for k, content in dictionaries.items():
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        sizes[k] = 0
        for i in range(0, len(data), langid.WINDOW):
            coder = zstd.ZstdCompressor(dict_data=d, compression_params=zstd.ZstdCompressionParameters(**langid.PARAMETERS))
            sizes[k] += len(coder.compress(langid.BEFORE + data[i : i + langid.WINDOW] + langid.AFTER))
    first, second = sorted(sizes.values())[:2]
    return min(sizes, key=lambda k: (sizes[k], k)), second - first < max(1, langid.MARGIN * len(data) / 1000)


def test_language_against_plain_coding(spark):
    docs = common.table(spark, SF, "documents")
    found = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in everything(langid.op10_language_id(spark, SF))}
    dictionaries = langid.fit(docs.where(common.fold_of("doc_id", 4) != 2))
    rows = [r for r in docs.collect() if r["text"] and langid.LETTER.search(r["text"])][:80]
    assert {r["doc_id"]: found[r["doc_id"]] for r in rows} == {r["doc_id"]: plain_prediction(r["text"], dictionaries) for r in rows}


def test_language_rejects_narrow_margins(spark):
    """Ties of two languages, and long texts of no learned language, at any length by the same rule."""
    rng = random.Random(6)
    docs = common.table(spark, SF.replace("0.001", "0.01"), "documents")
    dictionaries = langid.fit(docs)
    tied = langid.Coder({"aa": dictionaries["en"], "bb": dictionaries["en"], "cc": dictionaries["de"]})
    for r in docs.where("lang = 'en' and length(text) > 200").limit(20).collect():
        lang, score, rejected = tied.predict(r["text"])
        assert (lang, rejected) == ("aa", True) and score <= 0.5
    coder = langid.Coder(dictionaries)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    for n in (1000, 3000, 6000):
        assert sum(coder.predict(" ".join(word() for _ in range(n)))[2] for _ in range(20)) >= 18
    texts = [r["text"] for r in docs.where("length(text) > 40").collect()]
    assert sum(coder.predict(t)[2] for t in texts if langid.LETTER.search(t) and len(set(t.split())) > 30) <= 0.005 * len(texts)


def test_language_sample_of_null_ids_is_bounded(spark):
    rows = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3000).alias("text"), F.lit("en").alias("lang"))
    assert 0 < len(langid.fit(rows)["en"]) <= langid.DICT_BYTES and langid.fit(rows)["en"].count(b"text") <= 2 * langid.SAMPLE_DOCS


# quality


def test_quality(spark):
    from collections import Counter

    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SF.replace("0.001", "0.01"), "labels").collect()}
    found = everything(quality.op2_quality(spark, SF.replace("0.001", "0.01")))
    held = [(labels[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) and all(0 <= r["score"] <= 1 for r in found)
    stats = quality.document_statistics(docs_of(spark, AWKWARD))
    assert Counter(len(r["stats"]) for r in stats.collect()) == {quality.N_STATS: len(AWKWARD)}
    assert {r["score"] for r in quality.score(stats, quality.fit(stats.select("stats", F.lit(1.0).alias("y"), F.lit(False).alias("calibrate")).limit(0))).collect()} == {0.5}


def test_quality_against_brute_force(spark):
    """All rows in one matrix, one solve, and isotonic regression by its max-min formula."""
    import zlib

    import numpy as np

    docs = common.table(spark, SF, "documents").collect()
    marks = {}
    for r in common.table(spark, SF, "labels").collect():
        marks.setdefault(r["doc_id"], []).append(r["quality"])
    y = {i: sum(v) / len(v) for i, v in marks.items() if None not in v}
    fold = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in docs}
    stats = {r["doc_id"]: np.array(quality.statistics(r["text"] or ""), dtype=np.float32).astype(float) for r in docs}
    base = [i for i in stats if i in y and fold[i] in (1, 2, 3)]
    x = np.array([stats[i] for i in base])
    scale = x.std(axis=0)
    waves = quality.Waves(x.mean(axis=0), np.where(scale > 1e-6, scale, 1.0))
    f = waves.of(x)
    penalty = np.diag([1e-6] + [quality.RIDGE] * (f.shape[1] - 1))
    beta = np.linalg.solve(f.T @ f + penalty, f.T @ np.array([y[i] for i in base]))
    raw = {i: float(np.clip(waves.of(s[None, :]) @ beta, -1, 2)[0]) for i, s in stats.items()}
    bins = {}
    for i in stats:
        if i in y and fold[i] == 4:
            bins.setdefault(round(raw[i] * 1000), []).append(y[i])
    at = sorted(bins)
    mean = lambda a, b: sum(sum(bins[k]) for k in at[a : b + 1]) / sum(len(bins[k]) for k in at[a : b + 1])
    value = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    blocks = {}
    for k, v in zip(at, value, strict=True):
        blocks.setdefault(round(v, 9), []).append((k / 1000, len(bins[k])))
    centres = [sum(p * n for p, n in b) / sum(n for _, n in b) for b in blocks.values()]
    got = {r["doc_id"]: r["score"] for r in everything(quality.op2_quality(spark, SF))}
    want = {i: float(np.clip(np.interp(r, centres, list(blocks)), 0, 1)) for i, r in raw.items()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 5e-3


def test_quality_of_awkward_tables(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    assert quality.document_statistics(docs_of(spark, AWKWARD).limit(0)).count() == 0
    stats = quality.document_statistics(docs_of(spark, AWKWARD))
    rows = stats.join(labels.dropna(), "doc_id").select("stats", F.col("quality").cast("double").alias("y"), F.lit(False).alias("calibrate"))
    scores = quality.score(stats, quality.fit(rows)).collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in scores)


def test_isotonic():
    import numpy as np

    at, value = quality.pooled(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.array([1.0, 1, 1, 2]))
    assert value.tolist() == [0, 0.5, 1] and at.tolist() == [1, 2.5, 4]


# near duplicates


def brute_components(rows, share=85):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    least = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    before = None
    while before != least:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i]) for i in sets}


def test_near_groups(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(60)]
    rows = [(100, " ".join(base)), (101, " ".join(base).upper())]
    for k in range(60):  # a crowd: each differs from the base, some near, some only nearly near
        own = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3])):
            own[at] = word()
        rows.append((200 + k, " ".join(own)))
    rows += [(i, " ".join(word() for _ in range(30))) for i in range(300, 320)] + [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c"), (6, "word " * 20_000), (7, "word " * 9)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in everything(near.near_groups(docs_of(spark, rows)))}
    assert got == brute_components(rows)
    assert near.near_groups(docs_of(spark, rows).limit(0)).count() == 0


def test_near_rows_that_share_ids(spark):
    """Links go by row: repeated and null ids lose none, whichever text comes first."""
    words = [f"w{i}x" for i in range(40)]
    a, b = " ".join(words), " ".join(reversed(words))
    for x, y in ((a, b), (b, a)):
        rows = [(1, x), (1, y), (2, y), (3, y)]
        got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in everything(near.near_groups(docs_of(spark, rows))))
        assert [(d, c) for d, c, _ in got] == [(1, 1), (1, 1), (2, 1), (3, 1)] and sum(k for *_, k in got) == 2
        assert sorted((r["doc_id"], r["text"]) for r in near.keep_one(docs_of(spark, rows)).collect()) == sorted([(1, x), (1, y)])
    rows = [(None, a), (None, a + " end"), (8, a + " end"), (None, b), (None, b), (9, None), (9, "")]
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in near.keep_one(docs_of(spark, rows)).collect()), key=str) == sorted([(8, a + " end"), (0, b), (9, "")], key=str)


def test_near_crowd_whose_pivot_links_to_none(spark):
    """1,200 members share band buckets; their smallest is linked to none, nearly all pairs are near misses, and few link."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(64)]
    rows = [(0, " ".join([*base[:52], *(word() for _ in range(12))]))]
    for k in range(1, 1200):
        own = list(base)
        own[rng.randrange(0, 30)] = word()
        own[rng.randrange(34, 60)] = word()
        rows.append((k, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in everything(near.near_groups(docs_of(spark, rows)))}
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    assert got == want and len(set(want.values())) > 20


def test_near_stage_takes_080(spark):
    """Near copies between 0.80 and 0.85 go in the pipeline's stage; op9 leaves them apart."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for k in range(60):
        base = [word() for _ in range(104)]  # 100 shingles
        own = list(base)
        for at in (20, 70):  # 10 of them: 90 / 110 = 0.818
            own[at] = word()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    docs = docs_of(spark, rows)
    assert {r["doc_id"] for r in near.keep_one(docs).collect()} == {2 * k for k in range(60)}
    assert near.near_groups(docs).where("kept").count() == 120
    for share in (80, 85):
        assert (1 - (share / 100) ** near.ROWS) ** near.n_bands(share) <= near.MISSED


def test_components_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1030)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 1000 for i in range(1000, 1030)}}


# decontamination


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    items = {i: [word() for _ in range(rng.randint(8, 40))] for i in range(12)}
    rows, want = [(900, None), (901, "")], set()
    for d in range(60):
        body = [word() for _ in range(rng.randint(0, 80))]
        i = d % 12
        own = list(items[i])
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[word()], [], [own[at], word()]])
        rows.append((d, " ".join([*body, *(w.title() + "," for w in own), *body[:5]])))
    hashes = decontam.WordHashes()
    for d, t in rows:
        for i, w in items.items():
            if t and decontam.best_stretch(hashes.of(decontam.plain_words(" ".join(w))), hashes.of(decontam.plain_words(t)))[0] <= decontam.edits_allowed(len(w)):
                want.add((d, i))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in everything(decontam.matches(docs_of(spark, rows), benchmark))}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 20
    clean = decontam.clean(docs_of(spark, rows), benchmark)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in got}


def test_decontamination_judges_rows(spark):
    item = " ".join(f"item{i}" for i in range(12))
    rows = [(None, f"x {item} y"), (None, "clean text"), (3, item), (3, "a clean row of the same id"), (4, None)]
    benchmark = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in decontam.clean(docs_of(spark, rows), benchmark).collect()}
    assert got == {(None, "clean text"), (3, "a clean row of the same id"), (4, None)}
    assert decontam.clean(docs_of(spark, rows), benchmark.limit(0)).count() == len(rows)
    assert decontam.matches(docs_of(spark, rows).limit(0), benchmark).count() == 0


@pytest.mark.parametrize(("n", "trials"), [(20, 200), (60, 150), (100, 100), (200, 80)])
def test_candidates_at_all_allowed_edits(n, trials):
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    texts = [[word() for _ in range(n)] for _ in range(trials)]
    items, hashes, windows, of = decontam.Items([(i, " ".join(w)) for i, w in enumerate(texts)]), decontam.WordHashes(), [], []
    for i, w in enumerate(texts):
        own = list(w)
        for _ in range(decontam.edits_allowed(n)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[word()], [], [own[at], word()]])
        doc = hashes.of([x.encode() for x in [*(word() for _ in range(30)), *own, *(word() for _ in range(2 * n))]])
        for start, size in sorted(items.windows(doc)):
            windows.append(doc[start : start + size])
            of.append(i)
    met = {i for i, ks in zip(of, items.candidates(windows, [n] * len(of)), strict=True) if i in ks}
    assert len(met) >= trials - 1


def test_best_stretch():
    import numpy as np

    a = lambda s: np.array([ord(c) for c in s], dtype=np.uint64)
    assert decontam.best_stretch(a("abcd"), a("xxabxcdyy")) == (1, 2, 7) and decontam.best_stretch(a("abc"), a("")) == (3, 0, 0)


# language model


def brute_force_model(rows, fold):
    """doc_id -> (n_tokens, n_known, train_tokens, base_score, score) by plain counting and expectation-maximisation over single pairs; rows: doc_id, text."""
    from collections import Counter, defaultdict
    from math import log2, log10

    def em(cells):
        w, total = lm.WEIGHT, sum(h for _, h in cells)
        for _ in range(200 if total else 0):
            w = min(sum(h * w * r / (w * r + 1 - w) for r, h in cells) / total, lm.MOST)
        return w

    c, h, c2, h2 = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        words = [*words_of(t), b"\n"]
        for prev, x in zip([b"\n", *words], words, strict=False):
            if fold[i] != lm.HELD_OUT:
                c[x] += 1
                c2[prev, x] += 1
                if fold[i] == lm.TUNING:
                    h[x] += 1
                    h2[prev, x] += 1
    n, held, v = sum(c.values()), sum(h.values()), len(c)
    m = em([((c[x] - k) / max(1, n - held) * (v + 1), k) for x, k in h.items()])
    p1 = lambda count, total: m * count / max(1, total) + (1 - m) / (v + 1)
    bucket = lambda k: int(log2(max(1, k)) + 1e-9)
    cells = defaultdict(list)
    for (prev, x), k in h2.items():
        kept = c[prev] - h[prev]
        cells[bucket(kept)].append(((c2[prev, x] - k) / kept / p1(c[x] - h[x], n - held) if kept else 0.0, k))
    weight = {b: em(x) for b, x in cells.items()}
    out = {}
    for i, t in rows:
        words = [*words_of(t), b"\n"]
        total = 0.0
        for prev, x in zip([b"\n", *words], words, strict=False):
            w = weight.get(bucket(c[prev]), lm.WEIGHT) if c[prev] else 0.0
            total += log10(w * c2[prev, x] / max(1, c[prev]) + (1 - w) * p1(c[x], n))
        out[i] = (len(words), sum(c[x] > 0 for x in words), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in words), total)
    return out


@pytest.mark.parametrize("heads", [(1 << 18, 1 << 20), (3, 2), (0, 0)])
def test_language_model(spark, monkeypatch, heads):
    """Whatever the head tables hold, the result is that of plain deleted interpolation over all words and pairs."""
    rng = random.Random(3)
    monkeypatch.setattr(lm, "HEAD_WORDS", heads[0])
    monkeypatch.setattr(lm, "HEAD_PAIRS", heads[1])
    monkeypatch.setattr(lm, "BINS", 1 << 16)  # bins so fine that they are single ratios
    rows = [(i, t) for i, t in AWKWARD if i is not None and i != 6] + [(6, "word " * 3000)]
    rows += [(20 + i, " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat", f"rare{i}"], [9, 5, 4, 3, 2, 1, 1], k=rng.randint(1, 30)))) for i in range(90)] + [(190, "unseen words only here"), (191, "The cat")]
    docs = docs_of(spark, rows)
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", common.fold_of("doc_id", 7).alias("f")).collect()}
    got = everything(lm.score(docs, lm.fit(docs)))
    want = brute_force_model(rows, fold)
    assert len(got) == len(rows)
    for r in got:
        n_tokens, n_known, train, base, total = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(total, rel=1e-4)
    by = {r["doc_id"]: r["score"] / r["n_tokens"] for r in got}
    assert by[191] > by[190]


def test_language_model_without_training(spark):
    docs = docs_of(spark, [(1, "a b"), (2, None)])
    got = {r["doc_id"]: r for r in everything(lm.score(docs, lm.fit(docs.limit(0))))}
    assert got[1]["score"] == 0 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[2]["n_tokens"] == 1
    assert lm.score(docs.limit(0), lm.fit(docs)).count() == 0


def test_language_model_scores_other_texts(spark, monkeypatch):
    """Texts on which the model was not fitted are scored by all its words and pairs too, those that training has once included."""
    monkeypatch.setattr(lm, "BINS", 1 << 16)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat", f"rare{i} alone{i}"], [9, 5, 4, 3, 2, 1, 2], k=rng.randint(1, 30)))) for i in range(90)]
    others = [(1000 + i, f"{t} the cat rare{i} alone{i} unseen") for i, t in rows[:40]] + [(2000, None)]
    docs = docs_of(spark, rows)
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", common.fold_of("doc_id", 7).alias("f")).collect()}
    want = brute_force_model(rows + others, fold | {i: lm.HELD_OUT for i, _ in others})
    got = everything(lm.score(docs_of(spark, others), lm.fit(docs)))
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in others]
    for r in got:
        n_tokens, n_known, train, base, total = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(total, rel=1e-4)


def test_language_model_moves_few_bytes(spark, monkeypatch):
    """Counting all words and pairs moves less than twice and a half the texts' bytes where most words are rare and few pairs come twice, as in a large corpus."""
    monkeypatch.setattr(lm, "HEAD_WORDS", 1000)
    rng = random.Random(9)
    docs = docs_of(spark, [(i, " ".join(f"word{int(30_000 * rng.random() ** 4)}" for _ in range(800))) for i in range(300)])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    sc = spark.sparkContext

    def moved():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(k) for k in range(stages.size()))}

    earlier = moved()
    assert lm.score(docs, lm.fit(docs)).agg(F.sum("n_tokens")).first()[0] == 300 * 801
    total = sum(n for k, n in moved().items() if k not in earlier)
    assert 0 < total < 2.5 * size


def test_language_model_is_proper(spark):
    """The probabilities of all words after a context, and of one unseen word, add up to 1."""
    from collections import Counter

    import numpy as np

    rows = [(i, f"the cat {'sat' if i % 3 else 'ran'} on the mat {i % 5}") for i in range(60)]
    docs = docs_of(spark, rows)
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", common.fold_of("doc_id", 7).alias("f")).collect()}
    model = lm.fit(docs)
    c, c2 = Counter(), Counter()
    for i, t in rows:
        if fold[i] != lm.HELD_OUT:
            words = [*words_of(t), b"\n"]
            c.update(words)
            c2.update(zip([b"\n", *words], words, strict=False))
    total = model.p1(0, model.n)
    assert sum(model.p1(n, model.n) for n in c.values()) + total == pytest.approx(1)
    for prev, n in c.items():
        w = float(model.context_weight(np.array([n]))[0])
        p = sum((1 - w) * model.p1(k, model.n) * 10 ** float(model.gain(np.array([c2[prev, x]]), np.array([n]), np.array([k]))[0]) for x, k in c.items())
        assert p + (1 - w) * total == pytest.approx(1)


# pages


def page(text, extra=""):
    return f'<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>{text[:5]}</h1><p>{text}<br>more &amp; more<p>Share this now{extra}</article><aside>side</aside><form>f</form><footer>&copy; foot</footer></body></html>'


def test_pages(spark):
    comments = '<div class="comments"><p>a reader says</p></div>'
    rows = [(i, "http://h.example/a", page(f"text {i} <b>bo</b>ld", comments)) for i in range(8)]
    rows += [(20, None, None), (21, "http://h.example/b", ""), (22, "http://x.example/", "<div class='ad'>no</div><div><p>plain   page\n here</p></div>"), (23, "http://h.example/c", page("cut")[:330])]
    got = {r["page_id"]: r["text"] for r in everything(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert got[3] == "text text 3 bold more & more" or got[3] == "text text 3 bold more & more Share this now"
    assert got[20] == got[21] == "" and got[22] == "plain page here" and got[23].startswith("cut")
    assert not any(w in got[5] for w in ("reader", "cookies", "Home", "foot", "side", "var"))
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def wrapper_of(pages):
    import functools

    return html.Wrapper(functools.reduce(html.merged, [html._constants_shortened(html.folded(html.parse(p))) for p in pages]), len(pages))


def test_a_block_of_few_pages_is_no_template():
    shell = "<html><body><article><h1>t{i}</h1><p>text {i}</p>{extra}<div>Read on in print</div></article></body></html>"
    pages = [shell.format(i=i, extra="<blockquote>said once</blockquote><h3>of one page</h3>" if i == 4 else "<pre>pre of three</pre>" if i > 16 else "") for i in range(20)]
    wrapper = wrapper_of(pages)
    assert [wrapper.text(pages[i]) for i in (4, 5, 18)] == ["t4 text 4 said once of one page", "t5 text 5", "t18 text 18 pre of three"]
    one = wrapper_of([f"<article><p>a {i}</p><ul><li><b>x</b><p>twice in a page</p></li><li><p>twice in a page</p></li></ul></article>" if i < 3 else f"<article><p>a {i}</p></article>" for i in range(6)])
    assert "twice in a page" in one.text("<article><p>a 1</p><ul><li><p>twice in a page</p></li></ul></article>")


def test_wide_pages_keep_the_wrapper():
    """One wide page, or optional parts that add up over many pages, do not change what comes out of the others."""
    kinds = lambda n, at: "".join(f"<section class='{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x'><p>own {at}</p></section>" for k in range(at, at + n))
    shell = "<body>{own}<div class='qq'>All rights</div><div><p>words outside {i}</p></div><article><p>text {i}</p><div>Read on in print</div></article></body>"
    for pages in (
        [shell.format(i=i, own=kinds(300, 0) if i == 3 else "") for i in range(12)],
        [shell.format(i=i, own=kinds(3, 3 * i)) for i in range(200)],
        [shell.format(i=i, own=kinds(80, 0)) for i in range(40)],
    ):
        wrapper = wrapper_of(pages)
        assert wrapper.has_main and {wrapper.text(p) for p in pages} == {f"text {i}" for i in range(len(pages))}
    many = wrapper_of([shell.format(i=i, own=kinds(3, 3 * i)) for i in range(200)])
    assert len(many.expression[1][0][1]) <= 3 * html.WIDE


def test_deep_and_broken_pages():
    for deep in (600, 1200, 20_000):
        deep_page = "<div>" * deep + "hello <p>world" + "<nav>menu</nav>"
        assert html.Wrapper(None, 0).text(deep_page) == "hello world" == wrapper_of([deep_page] * 3).text(deep_page)
    assert html.Wrapper(None, 0).text("<div>" * 300 + "<nav>menu<div>more</div></nav><p>text</p>" + "</x>" * 20_000) == "text"
    assert html.Wrapper(None, 0).text("a < b " * 50_000).count("a < b") == 50_000


def test_the_wrapper_finds_the_article_without_names():
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta"]) + str(rng.randrange(99)) for _ in range(n))
    pages, articles = [], []
    for i in range(24):
        title, parts = f"{words(5)} T{i}", [words(40) for _ in range(rng.randint(2, 6))]
        links = "".join(f'<li><a href="/{k}">{words(4)}</a></li>' for k in range(5))
        said = "".join(f'<div class="qq"><b>{words(1)}</b><p>{words(8)}</p></div>' for _ in range(rng.randint(0, 3)))
        pages.append(
            '<body><div class="bb"><div class="cc">Site name</div><ul><li>Home</li><li>About</li></ul></div>'
            f'<div class="dd"><div class="ee"><h1>{title}</h1><div class="jj">{"".join(f"<p>{p}</p>" for p in parts)}<div class="kk">Read on in print</div></div></div>'
            f'<div class="ff">{links}<span>{words(6)} S{i}</span></div></div><div class="ii">{said}</div><div class="gg">All rights {i} reserved</div></body>'
        )
        articles.append(" ".join([title, *parts]))
    wrapper = wrapper_of(pages)
    assert not wrapper.named and [wrapper.text(p) for p in pages] == articles
    assert all(html.Wrapper(None, 0).text(p) != a for p, a in zip(pages, articles, strict=True))


def test_longest_common_subsequence(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    for n, m in ((0, 3), (1, 1), (7, 9), (40, 31)):
        a, b = rng.integers(0, 4, n), rng.integers(0, 4, m)
        want = html._pairs(a, b)
        monkeypatch.setattr(html, "CELLS", 20)
        split = html._pairs(a, b)
        monkeypatch.undo()
        for found in (want, split):
            assert len(found) == len(want) == int(html._lengths(a, b)[-1][-1]) and all(a[i] == b[j] for i, j in found) and found == sorted(found)


def test_wrapper_inference():
    e = lambda s: html.folded(html.parse(s))
    w = html.merged(e("<ul><li>a</li><li>b</li></ul><p>x</p>"), e("<ul><li>a</li></ul><h2>t</h2><p>y</p>"))
    ul, h2, p = w[1]
    assert ul[1][0][3] == 1 and h2[2] == 1 and p[1][0][4] is None and p[2] == 0


# surrogates


def test_surrogates(spark):
    text = "Mrs. Anna Miller (a.b@mail.example.com, +1 (212) 555-0199) met Mr. John Smith; card 4539 1488 0343 6467, host 10.2.3.4. г-жа Ольга Иванова"
    found = [(k, e) for *_, k, e in pii.entities(text)]
    assert [k for k, _ in found] == ["person:f", "email", "phone", "person:m", "card", "ip", "person:f"]
    made = dict(zip(found, (pii.surrogate(k, e) for k, e in found), strict=True))
    assert all(k != (k[0], v) for k, v in made.items())
    card = [int(c) for c in made["card", "4539 1488 0343 6467"] if c.isdigit()]
    assert pii._luhn(card[:-1]) == card[-1] and made["card", "4539 1488 0343 6467"][4] == " "
    assert made["person:f", "Anna Miller"].split()[0] in pii.FIRST_NAMES["latin"]["f"] and made["person:f", "Ольга Иванова"].split()[0] in pii.FIRST_NAMES["cyrillic"]["f"]
    assert len({pii.permute(i, 1000, b"k", "t") for i in range(1000)}) == 1000
    rows = [(1, text), (2, "again a.b@mail.example.com"), (3, None), (4, ""), (5, "no data here"), (1, text)]
    got = everything(pii.replace(docs_of(spark, rows)))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[3]["text"] is None and by[5]["text"] == "no data here" and by[1]["n_entities"] == 7
    assert by[2]["text"] == "again " + made["email", "a.b@mail.example.com"] and made["email", "a.b@mail.example.com"] in by[1]["text"]


def test_further_mentions_of_a_person():
    text = "Dr. Anna Miller spoke. Later Anna Miller left; Miller was tired. Paul Weber met Weber's wife, Mr Weber stayed. Millerton is a town."
    found = pii.entities(text)
    assert [(text[a:b], e) for a, b, _, e in found] == [
        ("Anna Miller", "Anna Miller"), ("Anna Miller", "Anna Miller"), ("Miller", "Anna Miller"), ("Paul Weber", "Paul Weber"), ("Weber", "Paul Weber"), ("Weber", "Paul Weber"),
    ]
    put = [pii._put(text[a:b], k, e, pii.surrogate(k, e)) for a, b, k, e in found]
    assert put[0] == put[1] and put[0].endswith(" " + put[2]) and put[3].endswith(" " + put[4]) and put[0].split()[0] in pii.FIRST_NAMES["latin"]["f"]
    assert pii.surrogate("person", "Weber") == put[4]
    assert pii.entities("Anna said so. The Miller went home.") == []


def test_all_first_names_get_surrogates(spark):
    """Lone first names that fill their listed space; and a format whose space is full."""
    names = pii.FIRST_NAMES["latin"]["m"]
    rows = [(i, f"Mr {n} said so.") for i, n in enumerate(names)] + [(None, f"Mr {names[0]} said so."), (None, f"Mr {names[1]} went.")]
    rows += [(100 + i, f"Mr {chr(65 + i)} came") for i in range(26)]  # all 26 names of one letter
    got = everything(pii.replace(docs_of(spark, rows)))
    put = {}
    for r, in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), strict=True):
        put.setdefault(r["doc_id"], []).append(r["text"].split(" ")[1])
    first = [put[i][0] for i in range(len(names))]
    letters = [put[100 + i][0] for i in range(26)]
    assert len(set(first)) == len(names) and not set(first) & set(names) and all(any(w.startswith(n) for n in names) for w in first)
    assert len(set(letters)) == 26 and not set(letters) & {chr(65 + i) for i in range(26)}
    assert sorted(put[None]) == sorted(first[:2])


def test_surrogates_are_distinct_over_a_corpus(spark):
    rng = random.Random(9)
    made = [f"{rng.choice(pii.FIRST_NAMES['latin'][g])} {rng.choice(['Miller', 'Smith', 'Jones', 'Weber', 'Blanc'])}" for g in "mf" * 150]
    rows = [(i, f"Then {n} called +1 (212) 555-{i:04d} from 10.{i % 7}.0.{i % 9}.") for i, n in enumerate(made)]
    got = {r["doc_id"]: r["text"] for r in everything(pii.replace(docs_of(spark, rows)))}
    for kind in ("person", "phone", "ip"):
        to = {}
        for i, t in rows:
            old = [e for *_, k, e in pii.entities(t) if k.startswith(kind)]
            new = [e for *_, k, e in pii.entities(got[i]) if k.startswith(kind)]
            if kind == "person":
                new = [" ".join(got[i].split(" ")[1:3])]
            to.setdefault(old[0], set()).update(new)
        assert all(len(v) == 1 for v in to.values()) and len({x for v in to.values() for x in v}) == len(to) and not {x for v in to.values() for x in v} & set(to)


def test_colliding_surrogates_move_on(spark):
    found = spark.createDataFrame([("ssn", "111-11-1111", "222-22-2222"), ("ssn", "333-33-3333", "222-22-2222"), ("ssn", "444-44-4444", "111-11-1111")], "kind string, entity string, made string")
    moved = {r["entity"]: r["made"] for r in pii.moved_on(found).collect()}
    assert set(moved) == {"333-33-3333", "444-44-4444"} and len({"222-22-2222", *moved.values()}) == 3


# mixing


def test_mixing(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(240):
        kind = i % 3
        rows.append((i, " ".join(rng.choices(["good", "fine", "one", "two"] if kind == 0 else ["bad***", "worse***", "one"] if kind == 1 else ["stupid", "trash", "two"], k=20))))
        if i % 2:
            marks.append((i, int(kind == 0), int(kind == 2)))
    rows += [(500, None), (501, ""), (502, "one " * 20_000)]
    labels = spark.createDataFrame([*marks, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = everything(mixing.mixed(docs_of(spark, rows), labels))
    assert len(got) == len(rows) and all(r["rate"] >= 0 for r in got)
    total = sum(r["n_tokens"] for r in got)
    for d, t in mixing.TARGETS.items():
        assert sum(r["n_tokens"] * r["rate"] * r[f"q_{d}"] for r in got) / total == pytest.approx(t, rel=0.01)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["q_plain"] > 0.9 and by[1]["q_low"] > 0.9 and by[2]["q_toxic"] > 0.9
    with_rates = mixing.with_rates(docs_of(spark, rows), labels)
    assert {r["doc_id"]: round(r["mix_rate"], 9) for r in with_rates.collect()} == {r["doc_id"]: round(r["rate"], 9) for r in got}
    again = mixing.with_rates(with_rates, labels)
    assert again.columns == with_rates.columns and again.count() == len(rows)
    assert with_rates.columns[:-2] == [c.split()[0] for c in DOCS.split(", ")]
    assert {r["rate"] for r in mixing.mixed(docs_of(spark, rows[:5]), labels.limit(0)).collect()} == {1.0}


def test_rates_are_the_least_squares_minimum(spark):
    """Against non-negative least squares by active sets, over all rows at once."""
    import numpy as np

    rng = np.random.default_rng(4)
    for targets in ({"plain": 0.7, "low": 0.2, "toxic": 0.1}, {"plain": 0.94, "low": 0.05, "toxic": 0.01}):
        q = rng.dirichlet([0.6, 0.4, 0.1], 60)
        w = rng.integers(1, 50, 60).astype(float)
        rows = spark.createDataFrame([(*map(float, x), float(y)) for x, y in zip(q, w, strict=True)], "q_plain double, q_low double, q_toxic double, w double")
        steps = mixing.fitted(rows, targets)
        got = np.array([r["rate"] for r in rows.withColumn("rate", mixing.rate_of(steps)).collect()])
        order = {tuple(np.round(x, 12)): i for i, x in enumerate(q)}
        at = [order[tuple(np.round([r["q_plain"], r["q_low"], r["q_toxic"]], 12))] for r in rows.collect()]
        share, target = w / w.sum(), np.array([targets[d] for d in mixing.DOMAINS])
        root = np.linalg.cholesky(np.linalg.inv(q.T @ (q * share[:, None]))).T
        a = np.vstack([root @ (q * share[:, None]).T, np.diag(np.sqrt(mixing.RIDGE * share))])
        b = np.concatenate([root @ target, np.sqrt(mixing.RIDGE * share)])
        want = np.zeros(60)
        free = np.ones(60, dtype=bool)
        for _ in range(200):  # drop the negative, take back those whose gradient asks for it
            x = np.zeros(60)
            x[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (x[free] < -1e-12).any():
                free &= x > 0
                continue
            want, slope = x, a.T @ (a @ x - b)
            back = ~free & (slope < -1e-10)
            if not back.any():
                break
            free |= back
        assert got[np.argsort(at)] == pytest.approx(want, abs=6e-2) and (got >= 0).all()
        loss = lambda r: float(((a @ r - b) ** 2).sum())
        assert loss(got[np.argsort(at)]) <= loss(want) * 1.01 + 1e-9  # the minimum, to CLOSE


def test_unsettled_rates_fail_loudly(spark, monkeypatch):
    rows = spark.createDataFrame([(0.5, 0.3, 0.2, 3.0), (0.1, 0.9, 0.0, 1.0), (0.9, 0.0, 0.1, 2.0)], "q_plain double, q_low double, q_toxic double, w double")
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.fitted(rows, {"plain": 0.01, "low": 0.01, "toxic": 0.98})


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    source = common.table(spark, SF, "documents")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*source.columns, "mix_rate", "mix_copies"]
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    before = {r["doc_id"]: r["text"] for r in source.collect()}
    assert len(ids) == len(set(ids)) and 0.6 * len(before) < len(ids) < len(before)
    assert len({before[i] for i in ids}) == len(ids)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "mix"]


def corpus(spark, folder, rows, labels, items):
    """The three tables of the pipeline, with a column whose name the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
    spark.createDataFrame([(i, t, k, "s", len(t or ""), True) for i, t, k in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept: null and repeated ids, null and empty texts, ties, copies, passages of the benchmark."""
    import corpus_pipeline

    source = common.table(spark, SF, "documents").where("length(text) < 3000").orderBy("doc_id").limit(150).collect()
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").orderBy("item_id").limit(8).collect()] + [(99, None)]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in source]
    long = next(t for i, t, k in rows if k == "en" and t and len(t.split()) > 150).split()
    near_copy = [*long[:-1], "changed"]
    rows += [(None, None, None), (None, "", "en"), (9001, " ".join(long), "en"), (9002, " ".join(near_copy), "en"), (9003, f"{items[0][1]} and more", "en"), (9004, rows[0][1], None)]
    rows += [(None, " ".join(reversed(long)), "en"), (None, " ".join(reversed(long)), "en"), (rows[1][0], " ".join(reversed(long[:90])), None), (9005, "zz " * 2000, None)]
    labels = [(i, int(n % 3 > 0), int(n % 7 == 0)) for n, (i, _, _) in enumerate(rows) if i is not None and n % 2] + [(None, 1, 0), (9001, None, 1)]
    folder = corpus(spark, tmp_path, rows, labels, items)

    docs = common.table(spark, folder, "documents")
    columns, at = docs.columns, docs
    dictionaries = langid.fit(docs)
    hashes = decontam.WordHashes()
    words = [hashes.of(decontam.plain_words(t)) for _, t in items if t]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in at.select("doc_id", "text").collect()]
        at = common.staged(stage(spark, at, folder), name)
        got = [(r["doc_id"], r["text"]) for r in at.select("doc_id", "text").collect()]
        if name == "language":
            want = [(i, t) for i, t in before if t and langid.LETTER.search(t) and not plain_prediction(t, dictionaries)[1]]
        elif name == "exact_dedup":
            top = {}
            for i, t in before:
                top[t] = max(top.get(t, -1), -1 if i is None else i)
            want = [(None if i < 0 else i, t) for t, i in top.items()]
        elif name == "near_dedup":
            groups = {}
            for n, (_, c) in brute_components(list(enumerate(t for _, t in before)), near.STAGE_SHARE).items():
                groups.setdefault(c, []).append(before[n])
            least = {c: min((i for i, _ in g if i is not None), default=None) for c, g in groups.items()}
            assert len(got) == len(groups)
            assert sorted(map(str, (i for i, _ in got))) == sorted(map(str, least.values())) and set(got) <= set(before)
            want = got
        elif name == "decontaminate":
            held = lambda t: any(decontam.best_stretch(w, hashes.of(decontam.plain_words(t)))[0] <= decontam.edits_allowed(len(w)) for w in words)  # noqa: B023, E731
            want = [(i, t) for i, t in before if not held(t)]
        else:
            want = before
            assert at.columns == [*columns, "mix_rate", "mix_copies"] and at.where("mix_rate < 0 or mix_rate is null or mix_copies is null").isEmpty()
        assert sorted(got, key=str) == sorted(want, key=str), name
        assert name == "mix" or at.columns == columns
    kept = {i for i, _ in got}
    assert 9003 not in kept and 9002 not in kept and 9005 not in kept and len(got) < len(rows) - 10


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, corpus(spark, tmp_path, [], [], []))
    assert out.count() == 0 and out.columns[-2:] == ["mix_rate", "mix_copies"]


def test_decontamination_recall_on_a_table(spark):
    """Against the edit distance of every item to every text, over the small documents of a whole table."""
    sf = SF.replace("0.001", "0.01")
    docs = common.table(spark, sf, "documents").where("length(text) < 2500")
    benchmark = common.table(spark, sf, "benchmark").orderBy("item_id").limit(40)
    hashes = decontam.WordHashes()
    items = {r["item_id"]: hashes.of(decontam.plain_words(r["text"])) for r in benchmark.collect() if decontam.plain_words(r["text"])}
    want = set()
    for r in docs.where("doc_id % 4 = 0").collect():
        text = hashes.of(decontam.plain_words(r["text"]))
        have = set(text.tolist())
        for i, w in items.items():
            # each edit spares all words but one, so fewer common words than this are too far
            if sum(x in have for x in w.tolist()) >= len(w) - decontam.edits_allowed(len(w)) and decontam.best_stretch(w, text)[0] <= decontam.edits_allowed(len(w)):
                want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in everything(decontam.matches(docs.where("doc_id % 4 = 0"), benchmark))}
    assert got <= want and len(got) >= 0.9 * len(want)
