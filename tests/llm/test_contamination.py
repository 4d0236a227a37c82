import random

import pytest

from cairnflow.llm import contamination as C

VOC = [f"w{i:03d}" for i in range(400)]


def item(rnd, n=80):
    return [rnd.choice(VOC) for _ in range(n)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(doc, it):
    """Whether some run of at least RUN item words is within one edit in ten of some stretch of the document."""
    for a in range(len(it) - C.RUN + 1):
        for n in range(C.RUN, len(it) - a + 1):
            k = n // C.ONE_IN
            for p in range(len(doc)):
                for m in range(n - k, n + k + 1):
                    if p + m <= len(doc) and edit_distance(doc[p : p + m], it[a : a + n]) <= k:
                        return True
    return False


@pytest.mark.parametrize("seed", range(8))
def test_as_brute_force_finds(seed):
    rnd = random.Random(seed)
    it = item(rnd, 34)
    n = rnd.choice([20, 26, 30, 34])
    part = it[:n]
    for _ in range(rnd.choice([0, 2, 3, 5])):
        k = rnd.randrange(len(part))
        part = rnd.choice([part[:k] + ["zzz"] + part[k + 1 :], part[:k] + part[k + 1 :], part[:k] + ["zzz"] + part[k:]])
    doc = [rnd.choice(VOC) for _ in range(5)] + part + [rnd.choice(VOC) for _ in range(5)]
    items = C.Items([(1, " ".join(it))])
    assert bool(C.leaks(items, " ".join(doc))) == brute(doc, it)


def test_case_accents_punctuation_and_space_do_not_count():
    words = ["Été", "naïve", "coöperative", "Straße", "l’eau", "spółka", "ёлка"] * 6
    it = " ".join(words)
    items = C.Items([(5, it)])
    import unicodedata

    for text in (it.upper(), it.replace(" ", "\n> "), it.replace(" ", ", "), unicodedata.normalize("NFD", it), it.replace("É", "E").replace("ï", "i")):
        assert 5 in C.leaks(items, text), text


def test_places_point_into_the_text():
    rnd = random.Random(9)
    it = item(rnd, 40)
    text = "Before, all this; " + " - ".join(w.upper() for w in it) + " and after."
    n, edits, a, b = C.leaks(C.Items([(1, " ".join(it))]), text)[1]
    assert (n, edits) == (40, 0) and text[a:b].startswith(it[0].upper()) and text[a:b].endswith(it[-1].upper())


def test_shared_phrases_are_no_leak():
    rnd = random.Random(10)
    it = item(rnd)
    assert C.leaks(C.Items([(1, " ".join(it))]), " ".join(it[:20] + item(rnd, 60) + it[30:50])) == {}


SCHEMA = "doc_id long, text string, item_id string"


def test_nulls_empties_repeats_and_long_texts(spark):
    rnd = random.Random(11)
    a, b = " ".join(item(rnd)), " ".join(item(rnd))
    noise = " ".join(item(rnd, 20_000))
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, noise + " " + a + " " + noise, "c"), (4, a + " " + b, "c"), (4, a + " " + b, "c"), (None, b, "c")], SCHEMA)
    items = spark.createDataFrame([(1, a, None), (2, None, b), (3, "short", ""), (None, None, None)], "item_id long, text string, text_ref string")
    got = [(r["doc_id"], r["item_id"]) for r in C.find_leaks(docs, "doc_id", "text", items, "item_id", ["text", "text_ref"]).collect()]
    assert sorted(got, key=str) == sorted([(3, 1), (4, 1), (4, 2), (4, 1), (4, 2), (None, 2)], key=str)
    assert C.find_leaks(docs.where("doc_id < 0"), "doc_id", "text", items, "item_id", ["text"]).count() == 0
    assert C.find_leaks(docs, "doc_id", "text", items.where("item_id = 3"), "item_id", ["text"]).count() == 0


def test_against_the_tables(spark, sf_dir):
    got = C.p7_passages(spark, sf_dir).collect()
    assert all(r["words"] >= C.RUN and r["edits"] * C.ONE_IN <= r["words"] for r in got)


def test_short_words_in_single_blanks_are_found():
    letters = [chr(ord("a") + i % 26) for i in range(30)]
    text = " ".join(letters[:9] + letters[10:19] + letters[20:29])  # 27 of the 30 words, 53 characters
    assert 1 in C.leaks(C.Items([(1, " ".join(letters))]), text)


def test_several_automata_find_what_one_finds(spark, monkeypatch):
    rnd = random.Random(12)
    items = [(i, " ".join(item(rnd)), " ".join(item(rnd))) for i in range(12)]
    docs = spark.createDataFrame([(i, f"before {items[i % 12][1 + i % 2]} after {items[(i * 5) % 12][1]}", "x") for i in range(40)], SCHEMA.replace("item_id", "more"))
    frame = spark.createDataFrame(items, "item_id string, text string, text_ref string")
    find = lambda: sorted(tuple(r) for r in C.find_leaks(docs, "doc_id", "text", frame, "item_id", ["text", "text_ref"]).collect())
    whole = find()
    monkeypatch.setattr(C, "MAX_ITEM_CHARS", 1_500)
    assert C.item_shards(frame, "item_id", ["text", "text_ref"])[1] > 2
    assert find() == whole and len({r[:2] for r in whole}) >= 40


def test_words_are_spelled_with_their_marks():
    assert C.words("nai\u0308ve co\u00adop \u0301x _a_b 12") == ["naive", "coop", "x", "a", "b", "12"]
