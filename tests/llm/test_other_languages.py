"""Quality rules for languages other than the four with fixed words."""

import random

from tallyloom.llm import divergence

CYRILLIC = "и в не на что он как это по но дом река город книга вода хлеб друг рука земля время".split()
LATIN = "och att det som en på är av för med hus bok vatten vän hand jord tid stad flod bröd".split()


def sentence(rng, words, n):
    """Half of the words are among the ten frequent ones, the others are all different."""
    return " ".join(rng.choice(words[:10]) if k % 2 else rng.choice(words[10:]) + rng.choice(words) + rng.choice(words) for k in range(n))


def test_clean_texts_of_other_languages_are_kept(docs):
    rng = random.Random(3)
    english = "the of and to in is that for with it house river town book water bread friend hand earth time".split()
    rows = [(n, sentence(rng, english, 90), "en") for n in range(30)]
    rows += [(100 + n, sentence(rng, CYRILLIC, 90), "ru") for n in range(30)]
    rows += [(200 + n, sentence(rng, LATIN, 90), "sv") for n in range(30)]
    rows += [(300, " ".join(f"w{i}%%% &&&###" for i in range(80)), "ru"), (301, "и в " * 60, "ru"), (302, "one two", "o'x\\y"), (303, None, "")]
    found = {r["doc_id"]: r for r in divergence.judge(docs(rows)).collect()}
    assert all(found[n]["kept"] for n in found if n < 300) and len(found) == len(rows)
    assert not any(found[n]["kept"] for n in range(300, 304)) and not found[300]["base_failed"] and found[301]["base_failed"]
    assert set(divergence.top_words(docs(rows))) == {"ru", "sv"}
    assert set(CYRILLIC[:8]) & set(divergence.top_words(docs(rows))["ru"])
    assert "Python" not in divergence.judge(docs(rows))._jdf.queryExecution().analyzed().toString()


def test_one_row_of_a_language(docs):
    rng = random.Random(4)
    words = "d'un \\n a\"b 'x' y".split() + LATIN[:5]
    rows = [(1, sentence(rng, words + LATIN, 80), "xx"), (2, " ".join(f"w{i}" for i in range(70)), None)]
    found = {r["doc_id"]: r for r in divergence.judge(docs(rows)).collect()}
    assert found[1]["kept"] and found[1]["word_distance"] < 1e-6 and not found[2]["kept"]
