import re

from pyspark.sql import functions as F

from rillstone.llm import pii

from . import cases


def run(spark, texts, **kwargs):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace(docs, **kwargs).orderBy("doc_id").collect()]


def test_formats_and_coreference(spark):
    a, b, c = run(spark, [
        "Write to Jane.Doe@mail.example.com or JANE.DOE@MAIL.EXAMPLE.COM, ip 10.20.30.40, call +1 (509) 555-6973.",
        "card 4425679706863800 or 4425-6797-0686-3800; +1 509 555 6973 again; ssn 123-45-6789",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", DE89370400440532013000',
    ])
    m = re.fullmatch(r"Write to ([a-z]{4}\.[a-z]{3}@[a-z]{4}\.[a-z]{7}\.com) or (\S+), ip (\d+)\.(\d+)\.(\d+)\.(\d+), call \+1 \((\d{3})\) (\d{3})-(\d{4})\.", a)
    assert m and m[2] == m[1].upper() and m[1] != "jane.doe@mail.example.com"
    assert all(1 <= int(m[i]) <= 254 for i in range(3, 7))
    k = re.fullmatch(r"card (4\d{15}) or (4\d{3}-\d{4}-\d{4}-\d{4}); \+1 (\d{3}) (\d{3}) (\d{4}) again; ssn \d{3}-\d{2}-\d{4}", b)
    assert k and k[1] == k[2].replace("-", "") != "4425679706863800"
    assert (k[3], k[4], k[5]) == (m[7], m[8], m[9]) != ("509", "555", "6973")
    assert re.fullmatch(r'token = "[0-9a-f]{40}", DE\d{20}', c) and "370400440532013000" not in c and "04dbebab" not in c


def test_names_keep_gender_script_and_parts(spark):
    a, b = run(spark, ["Mr. John Smith met Mrs. Mary Smith. Later Mr. Smith left.", "Госпожа Анна Петрова и Г-н Петрова"])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Later Mr\. (\w+) left\.", a)
    assert m and m[2] == m[4] == m[5] != "Smith"
    assert m[1] in pii.GIVEN["m_latin"] and m[3] in pii.GIVEN["f_latin"]
    k = re.fullmatch(r"Госпожа (\w+) (\w+) и Г-н (\w+)", b)
    assert k and k[1] in pii.GIVEN["f_cyrillic"] and k[2] == k[3] != "Петрова" and re.fullmatch("[А-Яа-яё]+", k[2])


def test_surrogates_stay_distinct_when_draws_collide(spark):
    names = [f"{a}{b}o" for a in ("Bal", "Cor", "Dun", "Fel", "Gar", "Hol") for b in ("ak", "em", "in", "ot", "ur", "ys", "ab", "ed", "ig", "ol")]
    texts = [f"Mr. {n} Stone" for n in names] + [f"Mr. {n} Stone again" for n in names]
    got = run(spark, texts)
    first = [re.match(r"Mr\. (\w+) ", t)[1] for t in got]
    assert len(set(first[:60])) == 60 and first[:60] == first[60:]
    assert not set(first) & set(names)
    assert run(spark, texts, key="other")[:60] != got[:60]
    pii.BROADCAST_ROWS, before = 0, pii.BROADCAST_ROWS
    try:
        assert run(spark, texts) == got
    finally:
        pii.BROADCAST_ROWS = before


def test_edge_cases(spark):
    docs = cases.edge(spark)
    got = pii.replace(docs)
    assert set(got.columns) == {*docs.columns, "n_entities"}
    a = sorted(str((r.doc_id, r.text)) for r in docs.collect())
    b = sorted(str((r.doc_id, r.text)) for r in got.collect())
    assert a == b  # nothing to replace in these
    assert pii.replace(cases.empty(spark)).count() == 0
    long = spark.createDataFrame([(1, "a" * 300_000 + " b@c." + "d." * 5000 + " " + "1" * 100_000)], "doc_id long, text string")
    assert pii.replace(long).select(F.length("text")).first()[0] > 300_000


def test_planted_data_is_gone(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    pattern = r"[\w.]+@mail\d+\.example\.com|(?<!\d)\d{16}(?!\d)|\+\d \(\d{3}\) \d{3}-\d{4}|\b[0-9a-f]{40}\b|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
    after = {r.doc_id: r.text for r in pii.replace(docs).collect()}
    n = 0
    for r in docs.collect():
        for found in re.findall(pattern, r.text):
            n += 1
            assert found not in after[r.doc_id]
        if not re.search(r"\d", r.text):
            assert after[r.doc_id] == r.text
    assert n > 5
