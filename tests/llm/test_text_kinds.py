import pytest

from docmill.llm import language as L
from docmill.llm import textstats as X
from docmill.llm.common import table

SF = "/root/testdata/sf0.001"
TEXTS = {
    1: ("The board of the league met twice in the year and agreed on a plan for the schools of the region.", "prose"),
    2: ("Item;2010;2011\nLibrary;1,200;n/a\nArchive;;34.5 million\nShelter;12;(45)", "table"),
    3: ("Item\n2010\n2011\nLibrary\n1,200\nn/a\nArchive\n12\n34\nShelter\n(5)\n6", "table"),
    4: ("1a Long-term plan .......... 1,234\n1b Short note ...... 12\n2a Fund ............ 7", "table"),
    5: ("• urban library\n– rural archive\n* long shelter\n- open clinic", "list"),
    6: ("Alba Press Institute\nBelgrave Civic Fund\nCorwen Housing Trust\nDalby Arts Federation", "list"),
    7: ("qwrt pldf bcvx nmkl zxcv hgfd sdfg tyrw plkj mnbv cxzl kjhg", "junk"),
    8: ("new orchard " * 40, "junk"),
    9: ("�□? �� □□� ? �", "junk"),
    10: ("3f9a 00c1 d2e4 9b7a\n4c5d 6e7f 8a9b 0c1d\n1a2b 3c4d 5e6f 7a8b", "junk"),
    11: (None, None), 12: ("", None), 13: (" \n\t", None),
    14: ("我们感谢所有支持这项工作的人。委员会按照计划公布了年度预算。", "prose"),
    15: ("DER VORSTAND HAT DEN PLAN FÜR DAS JAHR IN DER VERSAMMLUNG MIT DEN SCHULEN GEPRÜFT.", "prose"),
}


def test_kinds(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()] * 2, "text_id long, pdf_text string")
    rows = X.text_stats(df, table(spark, SF, "lang_samples"), table(spark, SF, "common_words")).collect()
    assert len(rows) == len(TEXTS)
    assert {r.text_id: r.kind for r in rows} == {k: kind for k, (_, kind) in TEXTS.items()}
    one = next(r for r in rows if r.text_id == 1)
    assert one.words == 21 and one.stop_line_ratio == 1 and one.digit_ratio == 0 and one.common_word_ratio > 0.2
    none = X.text_stats(df.limit(0), table(spark, SF, "lang_samples"), table(spark, SF, "common_words"))
    assert none.count() == 0


def test_divergence_decides_not_the_majority_of_characters():
    import duckdb
    import numpy as np

    samples = duckdb.sql(f"SELECT lang, text FROM '{SF}/lang_samples.parquet'").fetchall()
    learned = X.Profiles.learn(samples, [r[0] for r in duckdb.sql(f"SELECT word FROM '{SF}/common_words.parquet'").fetchall()])
    reader = X.Reader(learned)
    parts = [t.split(". ")[0][:110] for lang, t in samples if lang == "en"][:14]
    clauses, prose = "\n".join(f"({c}) {t[0].lower() + t[1:]}" for c, t in zip("abcdefghijklmn", parts)), ". ".join(parts)
    for text, kind in ((clauses, "list"), (prose, "prose"), ("We thank all who were with us in the year. " * 30, "junk")):
        found = reader.lines(text)
        # Most characters are of the classes that most characters of prose are of.
        most = np.argsort(-found.spread[:, : len(X.CLASSES)].mean(0))[:2]
        if kind != "junk":
            assert {X.CLASSES[i] for i in most} <= {"function", "likely", "middling"}
        assert X._stats(reader, text)[0] == kind, text


def test_profiles_are_made_of_all_samples():
    letters = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    samples = [("en", " ".join(f"or{letters(25 * i + k)}" for k in range(25)) + ".") for i in range(60)]
    samples += [("zh", "".join(chr(0x4E00 + 40 * i + k) for k in range(40)) + "。") for i in range(60)]
    made = X.structures(samples)
    assert {t for _, t in samples} <= {t for kind, _, t in made if kind == "prose"}
    assert {w for lang, t in samples if lang == "en" for w in t[:-1].split()} <= {w for kind, sort, t in made if sort == "repeated" for w in t.split()}
    by = {}
    for kind, sort, t in made:
        if kind in ("list", "table"):
            by.setdefault((kind, sort), []).append(t.lower())
    assert len(by) == 2 * 14
    for (kind, sort), texts in by.items():
        text = "\n".join(texts)
        if "narrow" in sort:
            assert {w for lang, t in samples if lang == "en" for w in t[:-1].split()} <= set(X._letters(text).split()), sort
        else:
            assert {c for lang, t in samples if lang == "zh" for c in t[:-1]} <= set(text), sort
    # What only the later samples hold changes the profiles; rows given twice do not.
    first, whole, twice = (X.Profiles.learn(x, ["the"]).matrix for x in (samples[:40] + samples[60:], samples, samples * 2))
    assert (first != whole).any() and (whole == twice).all()


LABELS = [
    ("en", ["en"]), ("EN", ["en"]), ("en_GB", ["en"]), ("pt-BR", ["pt"]), ("es+en", ["en", "es"]), ("en & zh", ["en", "zh"]), ("русский", ["ru"]),
    ("Nederlands", ["nl"]), ("German and French", ["de", "fr"]), ("und", []), ("", []), (None, []), ("?", []), ("deu", ["de"]), ("zh-Hans", ["zh"]), ("mul", []), ("pt;en", ["en", "pt"]),
]


@pytest.mark.parametrize("label,codes", LABELS)
def test_labels(spark, label, codes):
    from pyspark.sql import functions as F

    assert sorted(spark.createDataFrame([(label,)], "l string").select(L.labelled(F.col("l"))).first()[0]) == codes


def test_passages():
    assert L.passages("One is here. Two is\nhere!  3.5 per cent? 第一句。第二句。\n- item one\n") == ["One is here.", "Two is here!", "3.5 per cent?", "第一句。", "第二句。", "- item one"]
    assert L.sentence("We are here now.") and not L.sentence("- we are here now.") and not L.sentence("A heading of words")
    assert not L.sentence("“in loco parentis et al”.") and not L.sentence("https://a.example/b.") and L.sentence("第二句在这里。")
    assert L.mend("TodavÃ\xada queda") == "Todavía queda" and L.mend("Ã la carte") == "Ã la carte"


@pytest.fixture(scope="module")
def network():
    import duckdb

    rows = duckdb.sql(f"SELECT lang, text, sample_id FROM '{SF}/lang_samples.parquet' ORDER BY sample_id").fetchall()
    held = [(lang, t) for lang, t, i in rows if i % 5 == 0]
    return L.fit([(lang, t) for lang, t, i in rows if i % 5], steps=260), held


def test_held_out_accuracy(network):
    net, held = network
    reader = L.Reader(net)
    got = [max(zip(sum(p * n for _, p, n in row), net.langs))[1] for row in reader.passages([t for _, t in held])]
    assert sum(g == lang for g, (lang, _) in zip(got, held)) >= 0.97 * len(held)


def test_blocks_do_not_change_results(network):
    import numpy as np

    net, held = network
    items = [L.as_bytes(t) for _, t in held] + [b"", b"a", b"a" * 3000]
    a, n = net.read(items, block=7)
    b, _ = net.read(items, block=512)
    assert np.allclose(a, b, atol=1e-4) and (n >= 1).all()
    assert np.allclose(net.read([items[3]])[0], a[3], atol=1e-4)


def test_documents(spark, network, monkeypatch):
    net, _ = network
    monkeypatch.setattr(L, "_network", lambda *a: net)
    en = "The board held meetings with the residents and approved the plan. The lessons will shape the coming programme."
    de = "Der Vorstand für Wasser prüfte in den entlegenen Gebieten die Jahresrechnung. Wir danken allen, die diese Arbeit möglich gemacht haben."
    rows = [(1, en, "en"), (2, en, None), (3, f"{en}\n{de}", "en-US"), (4, "- item\n12", "en"), (5, None, "en"), (6, "  ", "x"), (7, de, "fr"), (7, de, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(tuple(r) for r in L.found(df, df).collect())
    assert got == [(2, "en"), (3, "de"), (7, "de")]
    parts = L.label_passages(df, df).filter("doc_id = 3").orderBy("passage_no").collect()
    assert [p.lang for p in parts] == ["en", "de"] and all(p.confidence > 0.5 for p in parts)
    mixed = "The board held meetings with the residents of the district, und der Vorstand prüfte in den entlegenen Gebieten die Jahresrechnung der Schule"
    parts = L.label_passages(spark.createDataFrame([(1, mixed, None)], "doc_id long, text string, lang string"), df).orderBy("passage_no").collect()
    assert [p.lang for p in parts] == ["en", "de"] and sum(p.n_chars for p in parts) == len(mixed) and abs(parts[0].n_chars - mixed.index("und")) <= L.WINDOW
    assert L.label_documents(df, df).filter("doc_id in (5, 6)").select("lang").distinct().first()[0] is None


def test_a_network_is_trained_once(spark, monkeypatch):
    import numpy as np

    import uuid

    rows = [("en", f"The board met twice this year. {uuid.uuid4()}"), ("de", "Der Vorstand traf sich zweimal.")]
    monkeypatch.setattr(L, "FIRST_STEPS", 7)
    net = L.ByteGRU(["de", "en"])
    calls = []
    monkeypatch.setattr(L, "fit", lambda *a: calls.append(a) or net)
    first, second, other = L.trained(spark, rows, []), L.trained(spark, rows, []), L.trained(spark, rows[:1], [])
    assert len(calls) == 2 and other is net
    a, b = first.read([b"some words here"])[0], second.read([b"some words here"])[0]
    assert second.langs == net.langs and np.array_equal(a, b)
