import hashlib
import random
import re

from cairnlore.llm import pii
from pyspark.sql import functions as F


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(t):
    """The base spans, straight from their plain patterns."""
    t = t or ""
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(f"card:{m.start()}:{m.end()}")
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


PARTS = ["4111 1111 1111 1111", "4111-1111-1111-1112", "a@b.c", "x.y+z@mail-1.example.com", "@", ".", "10.0.0.1", "256.1.1.1", "1.2.3", "0001.02.3.255", "+49 (0)30 1234-5678",
         "+1", "(", "é", "🙂", "\n", " ", "_d@e.f", "12", "-", "7", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14", " THE", "378282246310005", "card ", "ssn 123-45-6789", "tel:"]


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(11)
    texts = [None, "", "a" * 20_000, "1" * 20_000, "1." * 20_000, "a@" + "b." * 20_000 + "c", "+1" + "(" * 50_000, "a@b.c_d@e.f"]
    texts += ["".join(rng.choices(PARTS, k=rng.randint(1, 14))) for _ in range(1500)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", pii.spans(F.col("text")).alias("s")).collect()
    for r in got:
        base = [f"{s.kind}:{s.start}:{s.end}" for s in r.s if s.kind in pii.BASE]
        assert base == plain_base(texts[r.i]), repr(texts[r.i])[:200]


def test_added_kinds_need_checksum_or_context(spark):
    cases = {
        "Konto: DE89 3704 0044 0532 0130 00 THE END": [("iban", "DE89 3704 0044 0532 0130 00")],
        "DE88 3704 0044 0532 0130 00": [],
        "GB82WEST12345698765432.": [("iban", "GB82WEST12345698765432")],
        "ref 123-45-6789": [],
        "his SSN 123-45-6789": [("ssn", "123-45-6789")],
        "order 378282246310005": [],
        "amex card 378282246310005": [("short_card", "378282246310005")],
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string").select("text", pii.spans(F.col("text")).alias("s"))
    for r in df.collect():
        assert [(s.kind, r.text[s.start : s.end]) for s in r.s] == cases[r.text], r.text


def test_mask_merges_and_keeps_columns(spark):
    rows = [("é🙂 a@b.c, 10.0.0.1@x.y end", "k"), (None, "k"), ("﻿plain", None), ("﻿x 4111 1111 1111 1111﻿", "")]
    got = pii.mask(spark.createDataFrame(rows, "text string, spans string"))
    assert got.columns == ["text", "spans"]
    assert [r.text for r in got.collect()] == ["é🙂 [EMAIL], [EMAIL] end", None, "﻿plain", "﻿x [CARD]﻿"]


def test_query_digests(spark, sf_dir):
    from cairnlore.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op7_personal_data(spark, sf_dir).collect():
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in pii.BASE]


def test_empty(spark):
    assert pii.mask(spark.createDataFrame([], "text string")).count() == 0


def found(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", pii.spans(F.col("text")).alias("s")).collect()
    return {r.text: [(s.kind, r.text[s.start : s.end]) for s in r.s] for r in rows}


def test_context_is_read_across_other_matches(spark):
    cases = {
        "SSN 123-45-6789, 234-56-7890": [("ssn", "123-45-6789"), ("ssn", "234-56-7890")],
        "é🙂 123-45-6789; 234-56-7890; SSN": [("ssn", "123-45-6789"), ("ssn", "234-56-7890")],
        "amex card valid 2027: 378282246310005": [("short_card", "378282246310005")],
        "378282246310005 12 34 (amex)": [],
        "378282246310005, 12, 34 (amex)": [("short_card", "378282246310005")],
        "SSN" + " " * 49 + "123-45-6789": [],
    }
    assert found(spark, cases) == cases


def iban(country, bban):
    number = int("".join(str(int(c, 36)) for c in bban + country + "00"))
    return f"{country}{98 - number % 97:02d}{bban}"


def test_ibans_at_every_start(spark):
    de, fr = "DE89370400440532013000", "FR1420041010050500013M02606"
    more = [iban("TR", "0006100519786457841326"), iban("SA", "80000000608010167519"), iban("AE", "0331234567890123456"), iban("BR", "00360305000010009795493C1"), iban("UA", "3223130000026007233566001"), iban("RU", "0445252254070281041234567890P")]
    cases = {
        f"{de} {fr}": [("iban", de), ("iban", fr)],
        f"AB12 {de}": [("iban", de)],
        f"é AB12 CD34 EF56 {de} X {de}": [("iban", de), ("iban", de)],
        f"{fr} THE {de} END": [("iban", fr), ("iban", de)],
        **{x: [("iban", x)] for x in more},
        f"TR34{more[0][4:]}": [],
        "AB12 " * 20_000: [],
    }
    got = found(spark, cases)
    assert {t: [x for x in s if x[0] == "iban"] for t, s in got.items()} == cases
