"""Language ID, toxicity, PII, BPE, licence scan: against libraries, brute force and held-out labels."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwork.llm import bpe, langid, licenses, pii, toxicity
from gleanwork.llm import queries as q

ODD = [None, "", " ", "\n", "it's 'sam ###'s ½ Ⅷ 一二三 <|endoftext|> Hi<|startoftext|>", "ΣΑΣ İz é\x1cab​c", "ß\xa0ö", "x" * 70, "ab" * 400 + "xyz" * 150]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, k) for k, t in enumerate(ODD)] + [(0, None, 0), (2, " ", 2), (None, "a b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int")


def test_bpe_equals_the_tokenizers_library(spark, sf_dir, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    lib.no_truncation(), lib.no_padding()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = bpe.token_digests(docs, ids="ids").collect()
    assert len(rows) == docs.count()
    text = {(r.doc_id, r.text) for r in docs.collect()}
    expected = {}
    for i, t in text:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        raw, decoded = np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)
        expected.setdefault(i, []).append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in expected[r.doc_id]


def test_bpe_of_scripts_without_blanks_equals_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    lib.no_truncation(), lib.no_padding()
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    texts = [" ".join("".join(rng.choices(letters, k=rng.choice([20, 30, 90]))) for _ in range(100)) for _ in range(4)]
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        model = bpe.WordBpe(f.read())
    for text, (raw, decoded) in zip(texts, model.encode_many(texts), strict=True):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids and decoded == lib.decode(ids, skip_special_tokens=False)


def test_bpe_encode_then_decode_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "Hello there, world", "old")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df)).first()
    assert out.decoded == "hello</w> there</w> ,</w> world</w>"
    assert bpe.encode(df.limit(0)).count() == 0


def test_segment_tree_equals_plain_merging():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        model = bpe.WordBpe(f.read())
    rank = dict(zip(model._pair_key.tolist(), model._pair_rank.tolist(), strict=True))
    rng = random.Random(3)
    for _ in range(150):
        word = "".join(rng.choice("thean ier"[:8]) for _ in range(rng.choice([1, 2, 3, 7, 15, 40, 66, 130]))).replace(" ", "s")
        b = np.frombuffer(word.encode(), np.uint8)
        s = [*model._plain[b[:-1]].tolist(), int(model._final[b[-1]])]
        while True:
            options = [(rank[(a << 20) | c], k) for k, (a, c) in enumerate(zip(s, s[1:], strict=False)) if (a << 20) | c in rank]
            if not options:
                break
            r, k = min(options)
            s[k : k + 2] = [int(model._merged[r])]
        assert np.frombuffer(model.encode_words([word])[0][0], "<u4").tolist() == s


def test_language_id_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = q.op8_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    kept = got[got.held_out]
    assert len(got) == 1000 and (kept.lang == kept.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_id_edges(spark, odd):
    model = langid.fit(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 3)} == {"und"}
    nothing = langid.fit(odd.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0
    signs = spark.createDataFrame([(1, "½ ² Ⅷ ③ 12"), (2, "½ a"), (3, "the dog " * 200_000)], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.identify(signs, model).orderBy("doc_id").collect()] == [True, False, False]


def test_codewords_lie_apart():
    for n in (2, 3, 5, 9):
        code = langid.code_matrix(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= 1 + (n > 2)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = q.op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    kept = got[got.held_out]
    toxic, clean = kept[kept.toxic == 1].score, kept[kept.toxic == 0].score
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.85
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_toxicity_edges(spark, odd):
    docs = spark.createDataFrame([(k, f"you {'idiot' if k % 2 else 'friend'} number {k}", "en") for k in range(80)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id: r.predicted for r in toxicity.classify(docs, model).collect()}
    assert all(scored[k] == k % 2 for k in range(80))
    rows = toxicity.classify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert {r.score for r in toxicity.classify(odd, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_toxicity_thresholds_come_from_all_labelled_rows(spark):
    """Of 3,000 rows 40 train the filters; the threshold is the best of the others, and languages are counted over all."""
    rng = random.Random(2)

    def row(k):
        bad = min(3, int(rng.expovariate(1.2)))
        words = [rng.choice("one two three four five six seven".split()) for _ in range(12)] + rng.sample("bad idiot stupid".split(), bad)
        rng.shuffle(words)
        return k, " ".join(words), "aa" if k else "rare", int(bad + rng.gauss(0, 0.7) > 1.5)

    made = spark.createDataFrame([row(k) for k in range(3000)], "doc_id long, text string, lang string, toxic int")
    docs, labels = made.select("doc_id", "text", "lang").repartition(3), made.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, per_class=20)
    assert model.languages == ["aa", "rare"]
    got = toxicity.classify(made, model).toPandas()
    both = toxicity.fit_and_classify(docs, F.lit(True), labels, per_class=20).toPandas().set_index("doc_id")
    assert np.allclose(both.score[got.doc_id], got.score) and (both.predicted[got.doc_id].to_numpy() == got.predicted.to_numpy()).all()

    def f1(chosen):
        return 2 * (got.toxic * chosen).sum() / (got.toxic.sum() + chosen.sum())

    assert f1(got.predicted) >= max(f1((got.score >= t).astype(int)) for t in np.unique(got.score)) - 0.005


def test_toxicity_blocks_equal_one_pass(monkeypatch):
    docs = [np.array([toxicity.word_parts(w) for w in t.split()]) for t in ["a bad idiot here"] * 20 + ["a nice friend here"] * 20]
    model = toxicity.train(docs, np.array([1] * 20 + [0] * 20), ["en"] * 40)
    text = " ".join(["word"] * 50 + ["bad", "idiot"] + ["word"] * 50)
    whole = model.score(text)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 7)
    assert abs(model.score(text)[0] - whole[0]) < 1e-6
    texts = [text, "", "bad", None, "a nice friend here", text + " bad idiot", "here", "a bad idiot here"]
    together = model.scores(texts)
    assert [t for _, t in together] == [model.score(t)[1] for t in texts]
    assert [p for p, _ in together] == pytest.approx([model.score(t)[0] for t in texts])


def test_training_improves_on_its_start():
    rng = random.Random(4)
    neutral = [f"n{k}" for k in range(300)]

    def text(toxic):
        words = [rng.choice(neutral) for _ in range(rng.randrange(15, 60))]
        # Either word alone is harmless; only the pair counts, which class odds of single words cannot tell.
        words[5:5] = ["bad", "idiot"] if toxic else rng.choice([["idiot", "bad"], ["bad"], ["idiot"]])
        return " ".join(words)

    marks = [k % 2 for k in range(1200)]
    docs = [np.array([toxicity.word_parts(w) for w in text(m).split()]) for m in marks]
    tests = [(m, text(m)) for m in marks[:400]]

    def auc(model):
        scores = [(m, model.score(t)[0]) for m, t in tests]
        return np.mean([(a > b) + 0.5 * (a == b) for m, a in scores if m for n, b in scores if not n])

    start, trained = (auc(toxicity.train(docs, np.array(marks), ["en"] * len(docs), epochs=e)) for e in (0, 6))
    assert trained > 0.9 and trained > start + 0.1


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub(r"\D", "", m)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}


def plain_spans(text):
    return [(k, *m.span()) for k, (p, ok) in PATTERNS.items() for m in re.finditer(p, text) if ok(m.group())]


def test_base_spans_equal_plain_patterns(spark, sf_dir):
    rng = random.Random(5)
    made = ["".join(rng.choice("a.@1-+ 5() é9x%") for _ in range(rng.randrange(60))) for _ in range(3000)]
    made += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111x", "+1 (523) 555-1055", "+1+1+12345678901", "x@y", "a@b.c.d-e", "000001.2.3.4"]
    made += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in made:
        assert pii.base_spans(text) == plain_spans(text), text


def test_tagger_finds_spans_of_unseen_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(docs.filter("doc_id % 2 = 0"))
    texts = [r.text for r in docs.filter("doc_id % 2 = 1").collect()]
    truth = {(k, *s) for k, t in enumerate(texts) for s in pii.base_spans(t)}
    found = {(k, *s) for k, spans in enumerate(model.added(texts)) for s in spans}
    assert len(truth & found) >= 0.7 * len(truth) and len(found - truth) <= 0.3 * len(found)


def test_pii_edges_and_redaction(spark, odd):
    model = pii.PiiModel(None)
    rows = pii.find(odd, model).collect()
    assert len(rows) == odd.count() and all(r.spans == [] for r in rows if r.doc_id in (0, 1, 2))
    text = "mail me@x.org or 10.0.0.1 or +1 (523) 555-1055 x" + "9" * 20000
    df = spark.createDataFrame([(1, text, "keep"), (2, None, None)], "doc_id long, text string, spans string")
    assert [r.text and r.text[:30] for r in pii.redact(df, model).orderBy("doc_id").collect()] == ["mail [EMAIL] or [IP] or [PHONE", None]
    assert pii.fit(odd.limit(0)).tagger is None


def test_tagger_adds_disguised_spans_and_leaves_the_rest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.fit(docs.filter("doc_id % 2 = 0"))
    texts = [r.text for r in docs.filter("doc_id % 8 = 1").collect()]
    plain = model.spans(texts)
    assert sum(len(every) - len(base) for base, every in plain) <= 0.002 * len(texts)
    rng, found, made = random.Random(3), 0, 0
    for text, (base, _) in zip(texts, plain, strict=True):
        for kind, s, e in base[:1]:
            own = pii.disguised(kind, text[s:e], rng)
            ((known, every),) = model.spans([text[:s] + own + text[e:]])
            made += 1
            found += any(k == kind and a < s + len(own) and s < b for k, a, b in every)
            assert set(known) <= set(every)
    assert made > 40 and found >= 0.6 * made


def test_windows_own_every_character_once_and_long_texts_are_decoded_in_parts(monkeypatch):
    for size in (1, 95, 96, 97, 160, 161, 1000):
        cuts = [pii.owned(w, size) for w in pii.windows_of(size)]
        assert cuts[0][0] == 0 and cuts[-1][1] == size and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
        assert all(w <= a and b <= w + pii.WINDOW for w, (a, b) in zip(pii.windows_of(size), cuts, strict=True))
    texts = ["call +1 (523) 555-1055 now " * 4, "write to anna@mail.example.org or not at all, the list goes on " * 3, "plain words only " * 20] * 10
    x, y = (np.stack(v).astype(np.int64) for v in zip(*[(x, y) for k, t in enumerate(texts) for _, x, y in pii.labelled_windows(t, k)], strict=True))
    model = pii.PiiModel(pii.train(x, y, steps=60), sure=0.5)
    mixed = " ".join(texts[:3]) * 30
    whole = model.spans([mixed, "", texts[0]])
    monkeypatch.setattr(pii, "WINDOWS_AT_ONCE", 5)
    assert model.spans([mixed, "", texts[0]]) == whole


def test_certain_windows_are_those_that_viterbi_leaves_outside():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger(1)
    tagger.p["trans"] += rng.normal(0, 0.5, tagger.p["trans"].shape).astype(np.float32)
    em = rng.normal(0, 1, (400, 12, pii.TAGS)).astype(np.float32)
    em[:, :, 0] += rng.uniform(0, 5, (400, 1))
    certain = tagger._certainly_outside(em)
    best = em[:, 0] + tagger.p["first"]
    clean = np.zeros((400, pii.TAGS), bool)
    clean[:, 0] = True
    for t in range(1, 12):
        options = best[:, :, None] + tagger.p["trans"][None]
        came, best = options.argmax(axis=1), options.max(axis=1) + em[:, t]
        clean = np.take_along_axis(clean, came, axis=1) & (np.arange(pii.TAGS) == 0)
    outside = clean[np.arange(400), best.argmax(axis=1)]
    assert not (certain & ~outside).any() and certain.sum() > 0.5 * outside.sum() > 20


def test_pii_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = q.op6_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        every = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(every) and every == sorted(every, key=lambda s: (list(PATTERNS).index(s[0]), s[1]))


def brute_licenses(text, matcher):
    """Every stretch of whole lines against every template."""
    lines = " ".join(licenses.normalized(text)).split("\n")
    lines = [l.split() for l in lines]
    best = {}
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            words = [w for l in lines[i:j] for w in l]
            own = set(zip(words, words[1:], strict=False))
            for name, template in licenses.TEMPLATES.items():
                t = [w for w in licenses.normalized(template) if w != "\n"]
                grams = set(zip(t, t[1:], strict=False))
                dice = 2 * len(own & grams) / max(1, len(own) + len(grams))
                if dice >= licenses.LEAST:
                    best[name] = max(best.get(name, 0), dice)
    return best


def test_licenses_equal_brute_force():
    matcher = licenses.LicenseMatcher()
    rng = random.Random(2)
    pool = [l for t in licenses.TEMPLATES.values() for l in t.split("\n")]
    for _ in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.6 else "some other words of the text" for _ in range(rng.randrange(1, 7))]
        if rng.random() < 0.5:
            lines = [" ".join(w for w in l.split() if rng.random() < 0.95) for l in lines]
        text = "\n".join(lines)
        assert {n: d for n, d, _, _ in matcher.match(text)} == pytest.approx(brute_licenses(text, matcher))


def test_licenses_edges(spark, odd):
    assert licenses.scan(odd).count() == 0 and licenses.scan(odd.limit(0)).count() == 0
    df = spark.createDataFrame([(1, "Copyright (c) 2020 A\n" + licenses.TEMPLATES["MIT"], 0.5)] * 2, "doc_id long, text string, dice double")
    assert [(r.license, r.dice) for r in licenses.scan(df).collect()] == [("MIT", 1.0)] * 2


def brute_anywhere(text):
    """Every stretch of words against every template."""
    words = [w for w in licenses.normalized(text) if w != "\n"]
    best = {}
    for name, template in licenses.all_templates().items():
        if len(template) > 4000:
            continue
        t = [w for w in licenses.normalized(template) if w != "\n"]
        grams = set(zip(t, t[1:], strict=False))
        for i in range(len(words)):
            own = set()
            for pair in zip(words[i:], words[i + 1 :], strict=False):
                own.add(pair)
                dice = 2 * len(own & grams) / (len(own) + len(grams))
                if dice >= licenses.LEAST:
                    best[name] = max(best.get(name, 0), dice)
    return best


def test_licenses_within_lines_equal_brute_force():
    matcher = licenses.LicenseMatcher()
    rng = random.Random(5)
    short = [t for t in licenses.TEMPLATES.values() if len(t) < 700]
    for n in range(30):
        own = [f"w{n}x{k}" for k in range(60)]
        copy = [w for w in rng.choice(short).split() if rng.random() < (1 if n % 2 else 0.96)]
        at = rng.randrange(len(own))
        text = (" " if n % 3 else "\n").join([" ".join(own[:at]), *[" ".join(copy)] * rng.choice([1, 1, 2]), " ".join(own[at:])])
        assert {m: d for m, d, _, _ in matcher.match_anywhere(text)} == pytest.approx(brute_anywhere(text))


def test_licenses_with_repeats_equal_brute_force():
    matcher = licenses.LicenseMatcher()
    rng = random.Random(7)
    short = [t for t in licenses.TEMPLATES.values() if len(t) < 400]
    for _ in range(25):
        lines = [rng.choice(short).split() for _ in range(2)] + [["foo", "bar", "this"]] * 2
        lines = [[w for w in rng.choice(lines) if rng.random() < 0.97] for _ in range(rng.randrange(1, 6))]
        text = " ".join(w for l in lines * rng.choice([1, 1, 3]) for w in l)
        assert {m: d for m, d, _, _ in matcher.match_anywhere(text)} == pytest.approx(brute_anywhere(text))


def test_long_licence_texts():
    matcher = licenses.LicenseMatcher()
    for name in ("GPL-3", "Apache-2.0", "LGPL-2.1"):
        text = "some words before " + licenses.all_templates()[name] + " and after it"
        assert (name, 1.0) in {m[:2] for m in matcher.match_anywhere(text)}
    text = "\n".join(f"Licensed under the Apache License, Version {i % 7}." for i in range(100_000))
    assert [m[0] for m in matcher.match_anywhere(text)] == ["Apache-2.0 notice"]
    mit = (licenses.TEMPLATES["MIT"].replace("software", "software x", 3) + "\n") * 1000
    assert [(m[0], m[1] > 0.98) for m in matcher.match_anywhere(mit)] == [("MIT", True)]


def test_licenses_in_documents_without_line_breaks(spark):
    mit = licenses.TEMPLATES["MIT"].replace("\n", " ")
    filler = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"{filler} Released under the MIT License. {filler}"), (2, f"{filler} {mit} {filler}"), (3, f"Copyright (c) 2020 A {mit}"), (4, "Copyright 2020 A. Released under the MIT License."), (5, f"{filler} under the license {filler}")]
    got = {(r.doc_id, r.license, r.dice) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT notice", 1.0), (2, "MIT", 1.0), (3, "MIT", 1.0), (4, "MIT notice", 1.0)}


@pytest.mark.parametrize("name", list(licenses.all_templates()))
def test_one_template_is_one_licence(name):
    """Each template's own text, alone and in a sentence, is that licence and no other of its family."""
    matcher, text = licenses.LicenseMatcher(), licenses.all_templates()[name]
    for shown in (text, "words of our own come first, " + text + " and others follow here"):
        assert [(m[0], m[1]) for m in matcher.identify(shown)] == [(name, 1.0)]


def test_two_licences_in_one_text_stand_beside_each_other():
    matcher, t = licenses.LicenseMatcher(), licenses.all_templates()
    for pair in (("GPL-3.0 header", "MIT"), ("BSD-2-Clause", "ISC"), ("BSD-3-Clause", "GPL-3.0 header")):
        got = matcher.identify(t[pair[0]] + "\nThe second part of this work has terms of its own, as follows below.\n" + t[pair[1]])
        assert {(m[0], m[1]) for m in got} == {(n, 1.0) for n in pair}


def test_matches_that_stand_against_brute_force():
    """None overlaps a better one; each that does not stand overlaps one at least as good that does."""
    matcher = licenses.LicenseMatcher()
    texts = [*licenses.all_templates().values()]
    for k in range(0, len(texts) - 1, 3):
        shown = texts[k][: len(texts[k]) * 4 // 5] + " and then " + texts[k + 1]
        every, standing = matcher.match_anywhere(shown), matcher.identify(shown)
        meets = lambda a, b: a[2] < b[3] and b[2] < a[3]
        assert set(standing) <= set(every) and not any(meets(a, b) for a in standing for b in standing if a is not b)
        assert all(m in standing or any(meets(m, s) and s[1] >= m[1] for s in standing) for m in every)
