import random

import numpy as np

from quillspark.llm import prose

WORDS = {"en": "the of and to in a is that for it on with as was be by are this at from or an have not".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split()}


def documents(seed=1, n=300):
    r = random.Random(seed)
    nouns = {"en": "service ticket table report owner session policy window record queue access change".split(), "de": "Dienst Tabelle Prüfung Vorlage Freigabe Warteschlange Kunde Fenster Rolle Sicherung".split()}

    def sentence(lang):
        return " ".join(r.choice(WORDS[lang]) if r.random() < 0.42 else r.choice(nouns[lang]) for _ in range(r.randint(8, 18))).capitalize() + "."

    out, junk = [], set()
    for i in range(n):
        lang = "de" if i % 4 == 0 else "en"
        text = "\n\n".join(" ".join(sentence(lang) for _ in range(r.randint(2, 5))) for _ in range(r.randint(1, 4)))
        k = i % 10
        if k == 1:
            text = text.upper()
        elif k == 2:
            text = text.lower().replace(".", "")
        elif k == 3:
            text = "\n".join(f"{j}. {x}" for j, x in enumerate(text.split("\n\n"), 1))
        elif k in (7, 8, 9):
            junk.add(i)
            text = {7: "\n".join(f"| {r.randint(0, 9999)} | AB-{r.randint(0, 999)} | {r.choice(nouns['en'])} |" for _ in range(12)), 8: "\n".join(f"- {r.choice(nouns['en'])} {r.choice(nouns['en'])} x{r.randint(0, 99)}" for _ in range(15)), 9: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400))}[k]
        out.append((i, text, r.choice(["en", "EN", "und", None])))
    return out + [(9001, None, None), (9002, "", "en"), (9003, " \n ", "en")], junk


def frames(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(lang, w, k) for lang, ws in WORDS.items() for k, w in enumerate(ws)], "lang string, word string, freq_rank int")


def test_junk_is_told_from_prose(spark, wide):
    docs, junk = documents()
    d, w = frames(spark, docs)
    got = {r.doc_id for r in prose.not_prose(wide(d), wide(w)).collect()}
    assert len(got & junk) >= 0.97 * len(junk) and len(got - junk) <= 0.03 * len(docs)


def test_statistics_and_contributions(spark):
    docs, _ = documents()
    d, w = frames(spark, docs)
    rows = {r.doc_id: r for r in prose.quality_statistics(d, w).collect()}
    assert len(rows) == len(docs)
    for i in (9001, 9002, 9003):
        assert rows[i].word_count == 0 and rows[i].common_words is None and rows[i].outlying_share == 0
    for r in rows.values():
        if r.distance_squared is not None:
            assert np.isclose(sum(r[f"from_{s}"] for s in prose.STATS), r.distance_squared, rtol=1e-3, atol=1e-3)


def test_statistics_of_a_unit():
    s, n, hits = prose.statistics(["The cat, 12!", "sat"], {"the": 1}, 1)
    assert (n, hits) == (4, [1]) and np.isclose(s[0], (3 + 3 + 2 + 3) / 4) and np.isclose(s[1], 2 / 13) and np.isclose(s[2], 2 / 13) and s[3] == 0.5


def test_empty_tables(spark):
    d, w = frames(spark, [(1, "some text here", "en")])
    assert prose.not_prose(d.limit(0), w).count() == 0 and prose.quality_statistics(d, w.limit(0)).count() == 1
