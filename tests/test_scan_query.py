"""The registered scan over a whole table against brute force."""

from __future__ import annotations

import re

from lodeseek.operators import sensitive
from lodeseek.queries import QUERIES


def test_scan_reports_every_kind_of_secret(spark, tmp_path):
    key = "aws_secret_access_key = '" + "aB3/" * 10 + "'"
    texts = [f"first\n{key}\nmail a.b@example.org", f'AWS "secret": "{"x" * 40}"', f"aws secret '{'x' * 39}'", "password = 'hunter2hunter2'\n123-45-6789", "AKIA" + "A" * 16, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = sorted((d, i, label) for d, t in enumerate(texts) for i, line in enumerate((t or "").splitlines(), 1) for label, p in sensitive.SECRETS + sensitive.PERSONAL if re.search(p, line))
    got = sorted(tuple(r) for r in QUERIES["r1_sensitive_scan"](spark, str(tmp_path)).collect())
    assert got == expected and sum(label == "AWS secret key" for *_, label in got) == 2
