"""The ladders of contact fields against SQL that tells repeats and steps without back-references."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from factweave.functions import contact
from factweave.plans import contact_sql

CASES = {
    "name": ["Asha Rao", "aaaa", "Aaaa", "abcdef", "fedcba", "qwerty", "Qwerty", "ababab", "abcabc", "Majd", "bcdfg", "Bcd Fgh", "José Núñez", "日本太郎", "O'Neil-Smith", "x", "", " ", None, "Jo", "Jean-Luc  Picard", "aabbaabbaabb", "aaaaabaaaaab", "A1", "Müller", "Ann\tLee", "xkcd brtfgh", "Z" * 60, "Anna Anna", "ywy"],
    "email": ["x", "", None, "a@b", "jo@firm.com", "jo@firm..com", "jo@.com", "jo@firm.c", "jo@firm.c0m", "jo@@firm.com", "test@firm.com", "Test@Firm.COM", "jo@Mailinator.com", "bcdfgh@firm.com", "bcd@firm.com", "bc@firm.com", "asd@firm.com", "jo@qwe.com", "jo@qwe.co.uk", " jo@firm.com ", "j o@firm.com", "rhythmly@firm.com", "strengthsx@firm.com"],
    "phone": ["9876501234", "1234567890", "+1111111111", "12345678", "87654321", "+90123456", "+98765432109", "+121212121", "+12121212", "+112112112", "919876501234", "929876501234", "09876501234", "19876501234", "5", "", None, "+49 (30) 1234-5670", "98.76.50.12.34", "+1234567890123456", "98765x1234", "5876501234", "٩٨٧٦٥٠١٢٣٤"],
    "message": ["hello", "", None, "please send me the report", "please send me the report!!!!", "spam spam spam spam words here", "aaaa aaaa aaaa aaaa aaaa", "bcdfg xkcdf qwrtp the of", "bcdfg xkcdf qwrtp lkjhg", "the code ab12cd is what we need", "quarterly revenue margins growth outlook", "Прошу прислать отчёт за год", "a b c", "aa bb cc dd ee ff", "We  would like   to see it", "Spam spam SPAM sPam now then"],
}


def made(field):
    """Strings out of short alphabets, in which repeats, steps and runs are frequent."""
    draw = random.Random(field)
    units = {"name": ["a", "b", "c", "ab", "st", "r", "e", "q", "z", " ", "é", "-", "Xy"], "email": ["a", "jo", "st", "qwe", "rth", ".", "@", "com", ".org", "x1"], "phone": ["1", "2", "12", "9", "98", "0", "345", "+", " ", "-", "(", "91"], "message": ["we", "the", "report", "bcdf", "spam", "x1y", " ", "  ", "!", "....", "ok", "Hrm"]}[field]
    glue = " " if field == "message" else ""
    return [glue.join(draw.choice(units) for _ in range(draw.randint(1, 12))) for _ in range(1_500)]


@pytest.mark.parametrize("field", contact_sql.FIELDS)
def test_ladders_against_sql(spark, field):
    values = CASES[field] + made(field)
    ladder = {"name": contact.score_name, "email": contact.score_email, "phone": contact.score_phone, "message": contact.score_message}[field]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    got = {r.id: (r.m.reason, r.m.score) for r in rows.select("id", ladder(F.col("v")).alias("m")).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE v (id INT, v VARCHAR)")
    c.executemany("INSERT INTO v VALUES (?, ?)", list(enumerate(values)))
    given = "SELECT id, " + ", ".join(f"{'v' if k == field else 'NULL::VARCHAR'} AS {k}" for k in contact_sql.FIELDS) + " FROM v"
    want = {i: (m.split("|")[0], float(m.split("|")[1])) for i, m in c.execute(f"WITH {contact_sql.scored(given)} SELECT id, {field}_raw FROM f").fetchall()}
    assert [(values[i], got[i], want[i]) for i in got if got[i] != want[i]] == []
    assert len(got) == len(values) and len({r for r, _ in got.values()}) >= 5


def test_distrust_and_the_log(spark):
    """Two failing fields pull down the others; the log has each failing field, composite ones included."""
    rows = [(1, "Asha Rao", "jo@firm.com", "9876501234", "please send me the report"), (2, "aaaa", "jo@firm.com", "9876501234", "please send me the report"), (3, "aaaa", "x", "9876501234", "please send me the report"), (4, None, None, None, None)]
    from factweave.operators import jobs

    df = spark.createDataFrame(rows, "id int, name string, email string, phone string, message string")
    marks = {k: f(F.col(k)) for k, f in zip(contact_sql.FIELDS, (contact.score_name, contact.score_email, contact.score_phone, contact.score_message), strict=True)}
    df = df.withColumns({f"{k}_raw": m for k, m in marks.items()})
    df = df.withColumns({f"{k}_check": c for k, c in contact.distrust({k: F.col(f"{k}_raw") for k in marks}).items()})
    log = sorted((r.id, r.field, r.reason, r.score) for r in jobs.failing_fields(df, "id", list(marks)).collect())
    assert log == [
        (2, "name", "repeated_chars", 0.2),
        (3, "email", "syntax", 0.2), (3, "message", "composite_distrust", 0.4), (3, "name", "repeated_chars", 0.2), (3, "phone", "composite_distrust", 0.4),
        (4, "email", "syntax", 0.2), (4, "message", "too_short", 0.2), (4, "name", "format", 0.2), (4, "phone", "impossible_length", 0.2),
    ]
