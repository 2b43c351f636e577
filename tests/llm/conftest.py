import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls, blanks, copies, near copies, shared passages, repeated words and odd white space."""
    rng = random.Random(7)
    vocabulary = {"en": "the of and to in that it was for with house tree walks quickly river".split(), "de": "der die und das nicht mit auf für haus straße läuft schön größe".split()}
    passage = [f"p{k}" for k in range(70)]
    texts = []
    for k in range(120):
        lang = "de" if k % 3 == 0 else "en"
        words = [rng.choice(vocabulary[lang]) + rng.choice(["", "", ",", ".", str(rng.randint(0, 99))]) for _ in range(rng.randint(1, 160))]
        if k % 10 == 4:
            words[len(words) // 2 : len(words) // 2] = passage
        texts.append((" ".join(words), lang))
    texts += [texts[5]] * 3 + [(texts[6][0] + " extra", "en"), (texts[7][0].replace(" ", " \n "), "de")]
    texts += [("the " * 300, "en"), ("a b " * 200, "en"), ("b a " * 150, "en"), ("", "en"), (None, "en"), (" \t\n ", None), ("12345 !!", "en"), ("x", None), ("A" * 5000, "en")]
    rows = [(k, t, lang, f"src{k % 3}", None if t is None else len(t)) for k, (t, lang) in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOCUMENT).repartition(5).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)
