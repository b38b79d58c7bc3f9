import random

import numpy as np
import pytest

from docmill.llm import batchdedup as B

SAME = [
    "https://www.some-league.example/files/a_b_c_2011.pdf", "http://some-league.example:80//files/A-B-C-2011.PDF?ref=home", "web:https://some-league.example/./files/a_b_c_2011-copy.pdf#toc",
    " <https://Some-League.example/archive/files/a%5Fb_c_2011 (1).pdf.pdf> ", "https://mirror.pagestore.example/fetch?u=https%3A%2F%2Fsome-league.example%2Ffiles%2Fa_b_c_2011%252Epdf",
    "https://cache.docsnap.test/20230514/https://some-league.example/files/a_b_c_2011.pdf/view", "https://someleague.example/files/a+b+c+2011_web",
]
OTHER = [
    "https://some-league.example/files/a_b_c_2012.pdf", "https://some-league.example/files/a_b_c_2011_v2.pdf", "https://other-league.example/files/a_b_c_2011.pdf",
    "https://some-league.example/download?doc=11&format=pdf", "https://some-league.example/download?format=pdf&doc=12&print=true", "https://some-league.example/files/a_b_c_part_2_2011.pdf",
]


def test_identity():
    assert len({B.identity(None, a)[0] for a in SAME}) == 1
    assert len({B.identity(None, a)[0] for a in [SAME[0], *OTHER]}) == 1 + len(OTHER)


def test_identity_without_separators():
    one = {B.identity(None, f"https://some-league.example/files/{x}.pdf")[0] for x in ("annual-report-2011", "AnnualReport2011", "annual_report2011")}
    assert len(one) == 1
    two = {B.identity(None, f"https://some-league.example/files/{x}.pdf")[0] for x in ("report-1-12", "report-11-2", "report-112")}
    assert len(two) == 3


def test_boundaries_are_content_defined():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(50_000))
    a = B.chunks(data, 32, 9, 128, 4096)
    b = B.chunks(b"something new" + data, 32, 9, 128, 4096)
    assert sum(n for _, n in a) == len(data) and all(n <= 4096 for _, n in a)
    assert len({h for h, _ in a} & {h for h, _ in b}) > 0.9 * len(a)
    assert B.boundaries(b"", 32, 9, 128, 4096) == [] and B.boundaries(b"x", 32, 9, 128, 4096) == [1]
    assert max(n for _, n in B.chunks(b"a" * 10_000, 32, 9, 128, 4096)) <= 4096


def rows(seed=4, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.choice([*SAME, *OTHER, None, " "] + [f"https://some-league.example/files/x_{rng.randrange(40)}.pdf"] * 6)
        out.append((i, i // 40, rng.choice(["Some League", None]), a))
    return out


def test_all_and_batches_agree(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, "k long, b int, c1 string, u string")
    want, first = set(), {}
    for k, _, _, a in data:
        who = B.identity(None, a)[0]
        if who:
            if who in first:
                want.add((first[who], k))
            else:
                first[who] = k
    got = {tuple(r) for r in B.repeats(B.check_all(df, "k", "c1", "u")).collect()}
    assert got == want
    store, found = str(tmp_path / "chunks"), set()
    for b in range(max(r[1] for r in data) + 1):
        found |= {tuple(r) for r in B.accept_batch(spark, df.filter(f"b = {b}"), store, "k", "c1", "u").collect()}
    assert found == want


def test_text_counts_where_there_is_no_address(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(500)]
    text = " ".join(rng.choice(words, 3000))
    near = text[:9000] + " changed " + text[9000:]
    data = [(1, "Some League", None, text), (2, "some league", None, near), (3, "Other", None, text), (4, None, None, None), (5, None, None, ""), (6, "Some League", None, None)]
    df = spark.createDataFrame(data, "k long, c1 string, u string, t string")
    assert {tuple(r) for r in B.repeats(B.check_all(df, "k", "c1", "u", "t")).collect()} == {(1, 2)}
    assert B.repeats(B.check_all(df.limit(0), "k", "c1", "u", "t")).count() == 0


def test_every_holder_of_equal_kin_counts(spark, tmp_path):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(rng.choice([f"w{i}" for i in range(900)], n))
    shared, a, b = prose(1500), prose(1500), prose(1500)
    host = "https://alba-civic-fund.example/files/"
    data = [
        (1, 0, "Alba", "https://other.example/x_2011.pdf", shared), (2, 0, "Alba", host + "members_2011.pdf", shared + a), (3, 1, "Alba", host + "annual_report_2011.pdf", shared + b),
        (4, 1, "Alba", host + "annual_reports_2011.pdf", shared + b + " end"), (5, 2, "Alba", host + "annual_reports_2011.pdf", shared + b + " end"), (6, 2, "Alba", host + "annual_reports_2012.pdf", shared + b),
    ]
    df = spark.createDataFrame(data, "k long, b int, c1 string, u string, t string")
    assert {tuple(r) for r in B.repeats(B.check_all(df, "k", "c1", "u", "t")).collect()} == {(3, 4), (3, 5)}
    store, found = str(tmp_path / "chunks"), set()
    for b in range(3):
        found |= {tuple(r) for r in B.accept_batch(spark, df.filter(f"b = {b}"), store, "k", "c1", "u", "t").collect()}
    assert found == {(3, 4), (3, 5)}


def test_text_without_address_repeats_an_addressed_one(spark, tmp_path):
    rng = np.random.default_rng(6)
    text, other = (" ".join(rng.choice([f"w{i}" for i in range(900)], 1500)) for _ in range(2))
    at = "https://alba-civic-fund.example/files/{}_2011.pdf"
    data = [
        (1, 0, "Alba Civic Fund", at.format("a"), text), (2, 1, "ALBA civic fund", None, text), (3, 1, "Other Fund", None, text),
        (4, 1, "Alba Civic Fund", None, other), (5, 2, "Alba Civic Fund", at.format("b"), other + " end"), (6, 2, None, None, text),
    ]
    df = spark.createDataFrame(data, "k long, b int, c1 string, u string, t string")
    assert {tuple(r) for r in B.repeats(B.check_all(df, "k", "c1", "u", "t")).collect()} == {(1, 2), (4, 5)}
    store, found = str(tmp_path / "chunks"), set()
    for b in range(3):
        found |= {tuple(r) for r in B.accept_batch(spark, df.filter(f"b = {b}"), store, "k", "c1", "u", "t").collect()}
    assert found == {(1, 2), (4, 5)}


def test_coverage_of_addresses_decides(spark):
    long = "https://alba-civic-fund.example/files/{}/full_statement_of_activities_and_of_accounts_of_the_members_and_the_schools_of_the_region_with_all_notes_and_remarks_of_the_auditors_for_the_whole_year_2011.pdf"
    data = [(1, "A", long.format("report")), (2, "A", long.format("repart")), (3, "A", long.format("report").replace("members", "teachers").replace("region", "county")), (4, "A", long.format("report").replace("2011", "2012"))]
    df = spark.createDataFrame(data, "k long, c1 string, u string")
    who = [B.identity(*r[1:])[0].encode() for r in data]
    size = lambda parts: sum(n for _, n in parts)
    parts = [set(B.address_chunks(w)) for w in who]
    cover = lambda i, j: size(parts[i] & parts[j]) / max(size(parts[i]), size(parts[j]))
    assert who[0] != who[1] and cover(0, 1) >= B.COVER_ADDRESS > cover(0, 2)
    assert {tuple(r) for r in B.repeats(B.check_all(df, "k", "c1", "u")).collect()} == {(1, 2)}


def test_exact_copy_without_address_beside_boilerplate(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice([f"w{i}" for i in range(900)], n))
    shared = prose(2600)
    a, b = shared + prose(1400), shared + prose(1400)
    at = "https://alba-civic-fund.example/files/{}_2011.pdf"
    df = spark.createDataFrame([(1, "Alba", at.format("one"), a), (2, "Alba", at.format("two"), b), (3, "Alba", None, b)], "k long, c1 string, u string, t string")
    assert {tuple(r) for r in B.repeats(B.check_all(df, "k", "c1", "u", "t")).collect()} == {(2, 3)}


def test_order_of_acceptance_counts_not_of_ids(spark, tmp_path):
    at = "https://alba-civic-fund.example/files/one_2011.pdf"
    one = lambda *ids: spark.createDataFrame([(i, "Alba", at) for i in ids], "k long, c1 string, u string")
    accept = lambda df: {tuple(r) for r in B.accept_batch(spark, df, str(tmp_path / "s"), "k", "c1", "u").collect()}
    assert accept(one(100)) == set()
    assert accept(one(5, 7)) == {(100, 5), (100, 7)}
    assert accept(one(100)) == set()  # a batch that comes again
    assert accept(one(5, 7)) == {(100, 5), (100, 7)}


def later_versions(n=220, seed=8):
    """Texts of few organisations and years that add to, cut or quote earlier ones."""
    rng = np.random.default_rng(seed)
    prose = lambda k: " ".join(rng.choice([f"w{i}" for i in range(700)], k))
    out = []
    for i in range(n):
        org, year = f"org-{rng.integers(3)}", 2010 + int(rng.integers(2))
        t = prose(800)
        if out and rng.random() < 0.7:
            one = out[int(rng.integers(len(out)))]
            old = one[3]
            if rng.random() < 0.7:
                org, year = one[1], one[4]
            cut = int(rng.integers(len(old) // 2))
            t = [old, old + prose(int(rng.integers(20, 500))), old[cut:], old[: len(old) - cut] + prose(100)][int(rng.integers(4))]
        url = None if rng.random() < 0.2 else f"https://{org}.example/files/{prose(1)}_report_{year}.pdf"
        out.append((i, org, url, t, year))
    return [r[:4] for r in out]


def one_by_one(data):
    """Every record against every accepted one."""
    accepted, found = [], set()
    share = lambda x, y: sum(h & B._LENGTH for h in x & y)
    for k, o, u, t in data:
        who, kin, _ = B.identity(o, u)
        a, w = {h for h, _ in B.address_chunks(who.encode())}, {h for h, _ in B.text_chunks(t.encode())}
        for k2, kin2, o2, a2, w2 in accepted:
            address = share(a, a2) / max(share(a, a), share(a2, a2), 1)
            text = share(w, w2) / max(share(w, w), 1) >= B.COVER_TEXT
            both, one = bool(a and a2), bool(a) != bool(a2)
            if kin == kin2 and (both and address >= B.COVER_ADDRESS or text and (not both and not one or both and address >= 0.5)) or one and text and o == o2:
                found.add((k2, k))
                break
        else:
            accepted.append((k, kin, o, a, w))
    return found


def test_against_brute_force(spark, tmp_path):
    data = later_versions()
    want = one_by_one(data)
    df = spark.createDataFrame(data, "k long, c1 string, u string, t string")
    got = {tuple(r) for r in B.repeats(B.check_all(df, "k", "c1", "u", "t")).collect()}
    assert len(want) > 25 and got == want  # a recall of 1
    store, found = str(tmp_path / "chunks"), set()
    for lo in range(0, len(data), 75):
        found |= {tuple(r) for r in B.accept_batch(spark, df.filter(f"k >= {lo} AND k < {lo + 75}"), store, "k", "c1", "u", "t").collect()}
    assert found == want


def test_probes_do_not_depend_on_what_is_common(spark, monkeypatch):
    data = rows(seed=9)
    df = spark.createDataFrame(data, "k long, b int, c1 string, u string")
    a = {tuple(r) for r in B.repeats(B.check_all(df, "k", "c1", "u")).collect()}
    monkeypatch.setattr(B.probes, "__defaults__", (B.COVER_ADDRESS, 3))
    assert a == {tuple(r) for r in B.repeats(B.check_all(df, "k", "c1", "u")).collect()}


def test_frequent_chunks_are_looked_up_alike(spark, monkeypatch):
    data = [(i, "o", f"https://hot.example/files/x_{i % 500}.pdf") for i in range(3000)]
    df = spark.createDataFrame(data, "k long, c1 string, u string")
    got = {tuple(r) for r in B.repeats(B.check_all(df, "k", "c1", "u")).collect()}
    assert got == {(i % 500, i) for i in range(500, 3000)}


@pytest.mark.parametrize("address", ["", "?", "http://", "::::", "/a/b", "https://x.example"])
def test_odd_addresses(address):
    B.identity("o", address)


def test_last_batch_agrees_with_the_single_pass(spark):
    sf = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{sf}/report_analysis_text.parquet")
    last = {r.text_id for r in texts.filter(texts.batch_num == texts.agg({"batch_num": "max"}).first()[0]).select("text_id").collect()}
    want = {(r.first_id, r.dup_id) for r in B.p5_found(spark, sf).filter("tab = 'report_analysis_text'").collect() if r.dup_id in last}
    rows = B.p5_last_batch(spark, sf).collect()
    assert {r.text_id for r in rows} == last and {(r.first_id, r.text_id) for r in rows if r.first_id is not None} == want and want
