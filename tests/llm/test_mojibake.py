import random

import pytest

from cairnflow.llm import mojibake as M

SENTENCES = {
    "de": "Der Brückenwärter prüft die gläsernen Flaschen und die Straße über den Hügel, während die Bäckerin fröhlich grüßt.",
    "fr": "La coopérative répare la clôture près de l’église, et le garçon a mangé des pâtes à la crème brûlée après l’été.",
    "es": "El niño compró un paraguas en la estación y mañana volverá a la montaña con su compañera más joven, ¿verdad?",
    "pl": "Stary przewoźnik płynął łódką przez wąską rzekę, a pszczelarka niosła świeży miód i żółte kwiaty do młyna.",
    "ru": "Сторож моста проверяет стеклянные бутылки, а заботливая пасечница продаёт свежий мёд на рыночной площади.",
    "en": "The glass workshop’s keeper says “no” – a café near the lighthouse charges 12 € for the naïve résumé.",
}


ODD = ["√13 ≈ 3.6, ± 0.1 µm", "NÃO ABRIR, SÃO PEÇAS", "Ðóra and Þál carry 35 m³", "├── a\n└── b", "À LA FIN", "“É” turns into “Ã‰” in the wrong reader"]


@pytest.fixture(scope="module")
def clean():
    rnd = random.Random(0)
    out = []
    for _ in range(3000):
        s = SENTENCES[rnd.choice(list(SENTENCES))].split()
        i = rnd.randrange(len(s))
        out.append(" ".join(s[i:] + s[:i]))
    # what authors wrote that looks like damage stands in clean records too, and is learnt from them
    return out + ODD * 12


@pytest.fixture(scope="module")
def model(clean):
    return M.Model(M.counts_of(clean))


@pytest.fixture(scope="module")
def margins(model, clean):
    return M.validated_margins(model, clean[:500] + ODD)


@pytest.mark.parametrize("lang", SENTENCES)
@pytest.mark.parametrize("read", ["cp1252", "mac_roman", "cp1251", "cp437", "cp850", "cp1250"])
def test_utf8_read_wrongly_round_trip(model, margins, lang, read):
    bytes_of = {b: c for c, b in M._byte_of(read).items()}
    text = SENTENCES[lang]
    bad = "".join(chr(b) if b < 128 else bytes_of.get(b, chr(b)) for b in text.encode("utf-8"))
    got, chains, gain = M.restore(model, bad, margins)
    assert chains and got == text and gain > margins[0]


def test_twice_and_in_places_and_in_small_letters(model, margins):
    once = lambda s: "".join(M_INV.get(b, chr(b)) if b > 127 else chr(b) for b in s.encode("utf-8"))
    M_INV = {b: c for c, b in M._byte_of("cp1252").items()}
    text = SENTENCES["de"]
    assert M.restore(model, once(once(text)), margins)[0] == text
    part = text.replace("Brückenwärter", once("Brückenwärter"))
    assert M.restore(model, part, margins)[0] == text
    low, chains, _ = M.restore(model, once(SENTENCES["fr"]).lower(), margins)
    assert chains and "répare" in low


def test_long_words_in_small_letters(model, margins):
    inverse = {b: c for c, b in M._byte_of("cp1252").items()}
    for word in ("проверяет", "стеклянные", "заботливая", "стеклянные" * 3):
        bad = "".join(inverse.get(b, chr(b)) for b in word.encode("utf-8")).lower()
        got, chains, _ = M.restore(model, f"мост {bad} мост", margins)
        assert chains and got == f"мост {word} мост"


def test_likeliest_is_the_best_of_all_readings(model, monkeypatch):
    r = M.READERS[-1]
    inverse = {b: c for c, b in M._byte_of("cp1252").items()}
    for word in ("мёд", "свежий", "рынок", "бутылки", "żółte"):
        bad = "".join(inverse.get(b, chr(b)) for b in word.encode("utf-8") if b > 127).lower()
        monkeypatch.setattr(M, "MANY", 1 << 20)
        every = [x for x in r.decode(bad) if model.known(x)]
        got = r.likeliest(model, bad, " a", "b ")
        assert len(got) == bool(every) and all(abs(max(model.score(f" a{x}b ") for x in every) - model.score(f" a{g}b ")) < 1e-9 for g in got)


@pytest.mark.parametrize("lang, meant, read", [("pl", "cp1250", "cp1252"), ("pl", "iso8859_2", "cp1252"), ("fr", "mac_roman", "cp1252"), ("ru", "cp1251", "koi8_r"), ("ru", "koi8_r", "cp1251"), ("ru", "cp866", "cp1251"), ("ru", "cp1251", "cp1252"), ("de", "cp1252", "mac_roman")])
def test_single_bytes_read_wrongly(model, margins, lang, meant, read):
    text = SENTENCES[lang].replace("’", "'").replace("–", "-")
    inverse = {b: c for c, b in M._byte_of(read).items()}
    bad = "".join(chr(b) if b < 128 else inverse.get(b, chr(b)) for b in text.encode(meant, "ignore"))
    got, chains, _ = M.restore(model, bad, margins)
    assert chains and sum(a != b for a, b in zip(got, text.encode(meant, "ignore").decode(meant))) <= 1


def test_clean_records_stay(model, margins, clean):
    for t in [*clean[500:1500], *ODD]:
        assert M.restore(model, t, margins)[1] == [], t


def test_all_clean_records_validate_the_margins_and_none_its_own_counts(spark, clean):
    # a sample of a few thousand would miss the one record that looks like damage to a model that has not learnt from it
    rare = "Straße fröhlich".encode("cp1252").decode("mac_roman")
    good = spark.createDataFrame([(f"{t} {i}",) for i, t in enumerate(clean * 2)] + [(rare,), (rare,), (None,)], "t string")
    parts = M.train(good)
    whole = M.Model(parts.sum(axis=0))
    differ = parts.sum(axis=0) - M.counts_of([r["t"] for r in good.where("t is not null").collect()])
    assert set(differ[M.AT_UNI :].nonzero()[0]) <= {10}  # but for the line ends between texts
    got = [(r["t"], r["single"]) for r in M.clean_gains(good, parts).collect()]
    assert len(got) == sum(not f"{t} {i}".isascii() for i, t in enumerate(clean * 2)) + 2
    fold = good.where(f"t = '{rare}'").select(M._fold("t")).first()[0]
    own = M.most_gains(M.Model(parts.sum(axis=0) - parts[fold]), [rare])[0][1]
    assert [g for t, g in got if t == rare] == [own, own] and own > M.most_gains(whole, [rare])[0][1]


SCHEMA = "doc_id long, text string, chains string"


def test_table(spark, clean):
    bad = "prÃ¼ft die glÃ¤sernen Flaschen"
    rows = [(1, bad, "x"), (1, bad, "x"), (2, None, "x"), (3, "", "x"), (4, "plain", "x"), (5, "lost � here", "x"), (None, bad, "x"), (6, "prüft " * 20_000 + bad, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    good = spark.createDataFrame([(t,) for t in clean] + [(None,)], "t string")
    got = {r["doc_id"]: r for r in M.find_garbled(docs, "doc_id", "text", good).collect()}
    assert set(got) == {1, 5, 6, None}
    assert got[1]["restored"] == "prüft die gläsernen Flaschen" and got[5]["restored"] is None and got[6]["restored"].endswith("gläsernen Flaschen")
    assert M.find_garbled(docs.where("doc_id < 0"), "doc_id", "text", good).count() == 0
    none = M.find_garbled(docs, "doc_id", "text", good.where("t is null")).collect()
    assert {r["doc_id"] for r in none} == {5}


def test_words_scored_together_as_one_by_one(model):
    words = ["Straße", "stra\u00dfe", "é", "проверяет", "Łódź!", "x³", "a" * 50 + "é"]
    for closed in (True, False):
        got = model.scores(words, [closed] * len(words))
        for w, g in zip(words, got):
            first = max((int(model.bi[M._hash2(32, ord(w[0]))]) + 0.05) / (int(model.uni[32]) + 1.0), M.NOVEL)
            assert abs(g - (__import__("math").log(first) + model.score(f" {w} " if closed else f" {w}"))) < 1e-9
    assert model.scores([], []).tolist() == []


def test_every_word_is_tried_under_every_chain(model):
    word = "Brückenwärter"
    bad = "Br\u00b3ckenw\u00e4rter"  # one letter of a long, otherwise likely word
    model.learn([(bad, True)])
    want = {}
    for i, (_name, m) in enumerate(M.SWAPS):
        v = bad.translate(m)
        if v != bad and model.known(v):
            want[v] = want.get(v, 0) | 1 << i
    kept = {v: bits for bits, _gain, v in model.words[bad, True]}
    assert all(want[v] == bits for v, bits in kept.items())
    best = lambda s: max(model.scores([s, s.lower()], [True, True]) - [0.0, 1.0])
    assert set(kept) == {v for v in want if best(v) - best(bad) > M.WORD_GAIN} and all(v != word or v in kept for v in want)


def test_a_reader_is_never_passed_over():
    rnd = random.Random(7)
    alphabet = [c for r in M.READERS for c in r.byte] + list("ab ãÃ")
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 6)))
        assert M.possible_readers(text) == [r for r in M.READERS if r.pattern.search(text)], text
        assert M.shows_damage(text) == any(M.READERS[i].pattern.search(text) for i in (0, 1, 3, 4)) or any("\x80" <= c <= "\x9f" or c == "�" for c in text)


def test_a_long_text_without_blanks(model, margins):
    assert M.restore(model, "a" * 60_000 + "é", margins)[1] == []
