"""Precision and recall of the spans that the trees add, on documents whose personal data is known; and redaction of repeated rows."""

import random

from pyspark.sql import functions as F

from helpers import frame, prose
from quire.llm.pii import KINDS, joined, personal_data, redacted


def corpus(n=1500):
    """Texts, and what is personal in them beside the base formats: cued national phones, obfuscated mails, cued cards with dots."""
    r, texts, want = random.Random(77), [], {}

    def luhn():
        d = [4, *(r.randrange(10) for _ in range(14))]
        total = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        return "".join(map(str, [*d, -total % 10]))

    for i in range(n):
        parts = [prose(i, 15)]
        # base formats, and what only looks like personal data
        parts.append(r.choice([f"call +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", f"write to ann{i}@host{i % 9}.example.org", f"visa {luhn()}", f"from 10.{i % 250}.3.4", "", ""]))
        parts.append(r.choice([f"order {r.randrange(10**9, 10**10)}", f"of 2024-0{r.randrange(1, 9)}-1{r.randrange(9)}", f"token {r.randbytes(12).hex()}", f"v{r.randrange(9)}.{r.randrange(9)}.{r.randrange(99)}", f"no {r.randrange(10**15, 10**16)}"]))
        kind = r.randrange(8)
        if kind < 3:
            number = luhn()
            head, span, k = [("phone: ", f"({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", 3), ("reach me ", f"bob{i} (at) example.com", 0), ("credit card ", f"{number[:4]}.{number[4:8]}.{number[8:12]}.{number[12:]}", 2)][kind]
            before = " ".join([*parts, head]).rstrip() + " "
            want[i] = (len(before), k, len(before) + len(span))
            texts.append(before + span + " thanks")
        else:
            texts.append(" ".join(parts))
    return texts, want


def test_precision_and_recall_by_kind(spark):
    texts, want = corpus()
    added = {}
    for row in personal_data(frame(spark, texts)).collect():
        base = {tuple(s) for s in row.base}
        added[row.doc_id] = {tuple(s) for s in row.spans} - base
    for k in (0, 2, 3):
        known = {(i, s) for i, s in want.items() if s[1] == k}
        found = {(i, s) for i, spans in added.items() for s in spans if s[1] == k}
        recall, precision = len(known & found) / len(known), len(known & found) / max(1, len(found))
        print(KINDS[k], len(known), round(precision, 3), round(recall, 3))
        assert recall >= 0.9 and precision >= 0.9, (KINDS[k], recall, precision)


def test_redaction_of_repeated_ids_and_clashing_columns(spark):
    texts = ["mail a@b.co now", "none", "ip 10.0.0.1 and a@b.co", "mail a@b.co now"]
    docs = frame(spark, texts, [1, 2, 1, 1]).withColumn("spans", F.lit("clash")).withColumn("text_sha256", F.lit("clash"))
    out = redacted(docs, personal_data(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "ip [ip] and [email]"), (1, "mail [email] now"), (1, "mail [email] now"), (2, "none")]


def test_many_matches_of_one_text(spark):
    """Places stay right over the blocks in which they are added up."""
    text = "é " + "a@b.co, " * 3000
    row = personal_data(frame(spark, [text, "a@b.co"])).select("doc_id", joined(F.col("base")).alias("b")).orderBy("doc_id").collect()
    assert row[0].b == ",".join(f"email:{2 + 8 * i}:{8 + 8 * i}" for i in range(3000)) and row[1].b == "email:0:6"
