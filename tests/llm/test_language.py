import numpy as np
import pytest

from strandworks.llm import language
from strandworks.llm.language import LANGUAGES, Languages, Nystroem, Vocabulary, _landmarks, grams, label_languages, named_language, normalise, sentences_of, training_rows, training_sentences

TEXT = {
    "en": "The authors think that this loop ends in the outer layer. Nobody has tested whether the gyrus can replace the column. During rest the field replays what the neuron sent in the morning.",
    "de": "Die Autoren vermuten, dass dieser Kreis in der Schicht endet. Niemand hat geprüft, ob das Feld von der Säule abhängt. Bei dem Schlaf wiederholt es, was am Morgen gelernt wurde.",
    "fr": "Les auteurs supposent que cette voie finit dans la couche. Personne n'a vérifié si le champ remplace la colonne. Pendant le repos il rejoue ce que le neurone a appris.",
    "es": "Los autores suponen que esta vía termina en la capa. Nadie ha comprobado si el campo sustituye a la columna. Durante el sueño repite lo que envió por la mañana.",
    "it": "Gli autori pensano che questa via finisca nello strato. Nessuno ha verificato se il campo sostituisca la colonna. Durante il riposo conserva ciò che ha imparato.",
    "pt": "Os autores acham que este caminho termina na camada. Ninguém verificou se o campo substitui a coluna. Durante o sono repete aquilo que aprendeu de manhã.",
    "nl": "De auteurs denken dat dit circuit in de laag eindigt. Niemand heeft nagegaan of het veld de kolom vervangt. Tijdens de slaap bewaart het wat een uur eerder is verstuurd.",
    "sv": "Författarna tror att denna väg slutar i skiktet. Ingen har prövat om fältet kan ersätta kolumnen. Under sömnen raderar det vad som lärdes på morgonen.",
    "ru": "Авторы полагают, что этот путь кончается в слое. Никто не проверил, может ли поле заменить столб. Во время сна оно повторяет то, что узнало утром.",
    "zh": "作者认为这条通路终止于外层。没有人检验过这个区域是否可以代替那一层。在休息期间它重放早上学到的东西。",
}


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), (" en-US", "en"), ("deu", "de"), ("zh-Hans-CN", "zh"), ("Brazilian Portuguese", "pt"), ("Español", "es"), ("und", None), ("??", None), ("", None), (None, None), ("unknown", None)])
def test_labels(label, code):
    assert named_language(label) == code


def test_sentences_and_grams():
    assert sentences_of("One. Two? «Três.» 四。五。\n\nSix") == ["One.", "Two?", "«Três.", "四。", "五。", "Six"]
    own, h = grams([" ab ", " ab ab "])
    assert len(set(zip(own.tolist(), h.tolist()))) == len(h)
    count = {i: len({t[a : a + n] for n in range(1, 5) for a in range(len(t) - n + 1)}) for i, t in enumerate([" ab ", " ab ab "])}
    assert {i: int((own == i).sum()) for i in (0, 1)} == count
    assert normalise("A1-b 2") == " a b "


def test_all_sentences_are_fitted():
    """More than 800 sentences of a language: the last ones and the fixed ones take part too."""
    rows = [(f"This is sentence number {'x' * (i % 30)} {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 100]}.", "en") for i in range(1000)]
    texts, y = training_sentences(rows)
    assert y.tolist().count(LANGUAGES.index("en")) == 1002
    assert normalise("We do not know whether the experiment worked and what follows from it.") in texts


def test_vocabulary_and_kernel():
    r = np.random.default_rng(1)
    known = np.unique(r.integers(0, 1 << 44, 500, dtype=np.uint64) & np.uint64(~((1 << 40) - 1) & (1 << 44) - 1 | 0xFF))
    h = np.concatenate([known, r.integers(0, 1 << 44, 300, dtype=np.uint64)])
    where, place = Vocabulary(known).find(h)
    assert {int(i): int(known[p]) for i, p in zip(where, place)} == {i: int(x) for i, x in enumerate(h) if x in set(known.tolist())} and (np.diff(where) > 0).all()
    texts, y = training_sentences([(TEXT[c], c) for c in LANGUAGES])
    features = Nystroem(texts, y, LANGUAGES, 3)
    marks = _landmarks(y, len(LANGUAGES), 3)
    sets = [{t[a : a + n] for n in range(1, 5) for a in range(len(t) - n + 1)} for t in texts]
    want = np.array([[len(a & sets[m]) / np.sqrt(len(a) * len(sets[m])) for m in marks] for a in sets])
    assert np.allclose(features._kernel(texts), want, atol=1e-5)
    coef = features.solve(np.ones(len(texts), dtype=bool), 1e-2)
    assert np.allclose(features.model(coef).scores(texts), features.phi[:, :-1] @ coef[:-1], atol=1e-3)


def test_sample_is_bounded_and_whole(spark):
    """Smallest hashes of each language, whatever the number of tasks; one key in a third of the rows moves once."""
    rows = [(i % 400 if i % 3 else 7, f"text {i % 400 if i % 3 else 7} words", "en" if i % 5 else "Deutsch") for i in range(3000)] + [(5000 + i, " ", "it") for i in range(50)] + [(6000, "testo", "it"), (6001, None, "it"), (6002, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = [training_rows(df.repartition(n), "doc_id", "text", "lang", 20) for n in (1, 9)]
    assert got[0] == got[1]
    count = {c: sum(x == c for _, x in got[0]) for c in ("en", "de", "it")}
    assert count == {"en": 20, "de": 20, "it": 1}


def test_rejection_and_own_languages(spark):
    own = Languages({"en": ("en",), "de": ("de",)}, {c: language._SEEDS[c] for c in ("en", "de")})
    df = spark.createDataFrame([(1, TEXT["en"], "en"), (2, TEXT["de"], "de"), (3, TEXT["ru"], "ru")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in label_languages(df, "doc_id", "text", "lang", languages=own, least_confidence=0.6).collect()}
    assert (got[1].lang, got[2].lang, got[3].lang) == ("en", "de", "und") and got[3].label_language is None


def test_labelling(spark):
    rows = [(i, TEXT[c], c) for i, c in enumerate(LANGUAGES)] + [(10, TEXT["it"], "en")]
    rows += [(20, TEXT["en"] + " " + TEXT["de"] + "\n" + TEXT["ru"], "en"), (21, TEXT["fr"], None), (22, None, "en"), (23, " \n", "en"), (24, "123 !!", "en"), (25, TEXT["sv"], "Swedish"), (26, TEXT["pt"], "??"), (26, TEXT["pt"], "??")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = {}
    for r in label_languages(df, "doc_id", "text", "lang").collect():
        got.setdefault(r.doc_id, {})[r.segment_no] = r
    for i, c in enumerate(LANGUAGES):
        assert [got[i][k].lang for k in sorted(got[i])] == [c]
    assert got[10][1].lang == "it" and got[10][1].label_language == "en"
    assert [got[20][k].lang for k in (1, 2, 3)] == ["en", "de", "ru"]
    assert got[21][1].lang == "fr" and got[21][1].label_language is None and 0.3 < got[21][1].confidence <= 1
    assert 22 not in got and 23 not in got and got[24][1].lang == "und" and got[25][1].label_language == "sv"
    assert label_languages(df.limit(0), "doc_id", "text", "lang").count() == 0
