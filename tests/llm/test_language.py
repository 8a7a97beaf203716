"""Operator 10: Viterbi against brute force, script narrowing, mixed text and held-out accuracy."""

import itertools
from collections import Counter

import numpy as np

from kvasir.llm import language


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 5, 6, 0, 4, 3]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(0, 3, (offsets[-1], 3)).astype(np.float32)
    path = language.viterbi(scores, offsets, 2.0)
    value = lambda s, p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
    for k, n in enumerate(sizes):
        s, got = scores[offsets[k] : offsets[k + 1]], tuple(path[offsets[k] : offsets[k + 1]])
        best = max(value(s, p) for p in itertools.product(range(3), repeat=n))
        assert abs(value(s, got) - best) < 1e-4


def model():
    texts = {"aa": "bana lana mana sana nana " * 30, "bb": "kith smith with pith fifth " * 30, "ru": "привет мир это слово дом " * 30}
    counts = {k: Counter(g for w in t.split() for g in language.grams(w)) for k, t in texts.items()}
    scripts = {k: Counter(language.script(w) for w in t.split() for _ in w) for k, t in texts.items()}
    return language.LanguageModel(counts, scripts)


def test_spans_of_mixed_text_and_scripts():
    m = model()
    text = "Bana lana mana sana, nana bana 12 kith smith with pith fifth with - привет мир"
    lang, score, spans = language.label([text], m)[0]
    assert [(s["lang"], text[s["start"] : s["end"]].split()[0]) for s in spans] == [("aa", "Bana"), ("bb", "kith"), ("ru", "привет")]
    assert lang == "bb" and 0 < score < 1
    assert language.script("ǅ") == "latin" and language.script("漢") == "han" and language.script("ا") == "arabic"
    # A script that no language was seen in leaves all of them.
    assert language.label(["漢字"], m)[0][0] in m.languages


def test_undetermined_and_empty():
    m = model()
    assert [x[0] for x in language.label([None, "", " 12 -- ", "_", "½ ² ① Ⅷ", "\u0301"], m)] == ["und"] * 6
    # Marks stay in their words.
    assert language._words.findall("हिन्दी e\u0301a 1a½") == ["हिन्दी", "e\u0301a", "a"]
    assert language.label(["bana"], language.LanguageModel({}, {}))[0][0] == "und"


def test_query_on_a_table(spark):
    rows = [(i, ("bana lana mana sana " if i % 2 else "kith smith with pith ") * (1 + i % 5), "aa" if i % 2 else "bb") for i in range(60)]
    rows += [(100, None, "aa"), (101, "123", None), (102, "bana " * 50000, None), (None, "lana", "aa"), (5, "kith", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("id", "n", "place", "what", "spans", "score"):
        df = df.withColumn(name, df["doc_id"])
    m = language.fit_on_fold(df)
    assert m.languages == ["aa", "bb"]
    out = language.identify(df, m).collect()
    assert len(out) == len(rows)
    truth = {i: lang for i, _, lang in rows if lang and i not in (5, 100, None)}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth)
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (100, 101, 102)} == {100: "und", 101: "und", 102: "aa"}
    assert language.identify(df.limit(0), m).count() == 0
    assert language.fit_on_fold(df.limit(0)).languages == []


def test_held_out_accuracy(spark):
    from kvasir.llm.queries import op10_language_spans

    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    held = op10_language_spans(spark, d).join(truth, "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 0


def test_pieces_have_the_whole_words_grams():
    for n in (1, 2, 39, 40, 41, 42, 43, 79, 80, 81, 82, 160, 161, 1000):
        for word in (("abcdefg" * n)[:n], ("\u0130xy" * n)[:n]):
            got = language.pieces(word)
            assert Counter(g for p in got for g in language._starting(p)) == Counter(language.grams(word.lower()))
            assert len(got) == len(language.cuts(word)) - 1


def test_long_runs_count_to_their_end():
    m = model()
    text = "banalanamanasana" * 20 + "kithsmithwithpith" * 60
    lang, score, spans = language.label([text], m)[0]
    assert lang == "bb" and 0.6 < score < 0.9 and [s["lang"] for s in spans] == ["aa", "bb"]
    assert spans[0]["start"] == 0 and spans[1]["start"] == spans[0]["end"] and abs(spans[0]["end"] - 320) <= 40 and spans[1]["end"] == len(text)
    # Where the script changes inside a run, each piece has its own.
    assert [s["lang"] for s in language.label(["bana" * 50 + "привет" * 50], m)[0][2]] == ["aa", "ru"]


def test_each_language_keeps_its_grams_and_scripts(spark):
    rows = [(i, "".join(chr(0x4E00 + (i * 37 + k) % 900) for k in range(400)), "zh") for i in range(20)] + [(100, "bana lana", "aa"), (101, "x" * 60 + "qqqzzz", "bb")]
    m = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_grams=25)
    assert m.languages == ["aa", "bb", "zh"] and {"latin", "han"} == set(m.allowed)
    assert {"^b", "ba", "ana", "qqz", "zz$"} <= set(m.gram) and len(m.gram) <= 75
    assert language.label(["bana lana"], m)[0][0] == "aa"


def test_more_languages_than_a_byte_counts():
    counts = {f"l{k:03d}": {f"^{chr(0x4E00 + k)}": 50, f"{chr(0x4E00 + k)}$": 50} for k in range(300)}
    m = language.LanguageModel(counts, {k: {"han": 10} for k in counts})
    assert [language.label([chr(0x4E00 + k)], m)[0][0] for k in (0, 255, 256, 299)] == ["l000", "l255", "l256", "l299"]


def test_spans_without_a_second_search(monkeypatch):
    """Only texts with words of several pieces are searched again; all have the spans and scores of a search."""
    m, pure, mixed = model(), "bana lana, mana sana. ", "kith smith with pith fifth with — привет мир ½ это слово, "
    texts = [pure * 3, mixed * 3, " ͏12 the ́ housé", "the the", "und\U00020000 der ñ́ñ́", "the-the the", "x", None, "a" * 200, "a" * 42, "a" * 41, ("İ" * 90 + " ") * 2 + pure]
    words = [language._places(t or "") for t in texts]
    found, whole = [], language._places
    monkeypatch.setattr(language, "_places", lambda t: found.append(t) or whole(t))
    out = language.label(texts, m)
    assert found == [texts[8], texts[9], texts[11]]
    for t, places, (lang, score, spans) in zip(texts, words, out, strict=True):
        assert [s["start"] for s in spans[:1]] == [a for a, _ in places[:1]] and [s["end"] for s in spans[-1:]] == [b for _, b in places[-1:]]
        assert all((s["start"] in {a for a, _ in places}) and (s["end"] in {b for _, b in places}) for s in spans)
        letters = {name: sum(b - a for a, b in places for s in spans if s["lang"] == name and s["start"] <= a < s["end"]) for name in m.languages}
        assert not places or score == letters[lang] / sum(letters.values()) and letters[lang] == max(letters.values())
