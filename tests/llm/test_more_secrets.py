"""Every kind of secret, the added ones too, against searches with the single rules."""

import random
import re

from tessera.llm.secrets import BASE, MORE, secret_spans

PARTS = ["ghp_", "ghs_" + "a1B2" * 10, "gho_" + "Z" * 36, "ghu_" + "x" * 35, "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN OPENSSH EC PRIVATE KEY-----", "-----BEGIN rsa PRIVATE KEY-----",
    "-----BEGIN PUBLIC KEY-----", "AKIA" + "A7" * 8, "AKIA", "0123456789abcdef" * 2, "deadbeef", "password: hunter2hunter2", "api_key='", "Token=\"abc.def-ghi\"", "é", "語", "\n", " ", "-----", "=" ]


def expected(text):
    out = []
    for i, rule in enumerate(BASE + MORE):
        for m in re.finditer(rule.pattern, text):
            value = m.start() + (re.match(rule.head, m[0]).end() if rule.head else 0)
            if m.end() - value >= max(rule.least, 1):
                out.append((m.start(), i, rule.kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_all_kinds(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [*PARTS, "ghp_" + "q" * 40 + "\n-----BEGIN A B PRIVATE KEY-----"]
    rows = secret_spans(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(texts)
    seen = set()
    for r in rows:
        got = list(zip(r.kinds, r.starts, r.ends, strict=True))
        assert got == expected(texts[r.doc_id]), texts[r.doc_id]
        seen.update(r.kinds)
    assert seen == {rule.kind for rule in BASE + MORE}
