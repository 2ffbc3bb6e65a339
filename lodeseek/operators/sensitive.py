"""Scan of texts for secrets and personal data, line by line. [R1]"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import text as T

# --- fixed values ---------------------------------------------------------------------------------------------
SECRETS: list[tuple[str, str]] = [
    ("Private key block", r"(?iu)-----BEGIN (?:RSA|DSA|EC|OPENSSH|PGP|PRIVATE) KEY-----"),
    ("AWS access key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("AWS secret key", r"(?iu)aws(.{0,20})?(secret|access).{0,20}['\"][A-Za-z0-9/+=]{40}['\"]"),
    ("GitHub token", r"\b(?:ghp_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{20,}|gho_[A-Za-z0-9]{20,}|ghu_[A-Za-z0-9]{20,}|ghs_[A-Za-z0-9]{20,}|ghr_[A-Za-z0-9]{20,})\b"),
    ("OpenAI key", r"\b(?:sk-[A-Za-z0-9]{20,}|sk-proj-[A-Za-z0-9_-]{20,})\b"),
    ("Anthropic key", r"\bsk-ant-(?:api03-)?[A-Za-z0-9_-]{20,}\b"),
    ("Gemini/Google API key", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("OpenRouter key", r"\bsk-or-v1-[A-Za-z0-9]{20,}\b"),
    ("Groq key", r"\bgsk_[A-Za-z0-9]{20,}\b"),
    ("Perplexity key", r"\bpplx-[A-Za-z0-9]{20,}\b"),
    ("Cohere key", r"\bco_[A-Za-z0-9]{20,}\b"),
    ("Hugging Face token", r"\bhf_[A-Za-z0-9]{20,}\b"),
    ("Replicate token", r"\br8_[A-Za-z0-9]{20,}\b"),
    ("Slack token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("Stripe live secret", r"\bsk_live_[A-Za-z0-9]{16,}\b"),
    ("JWT token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9._-]{8,}\.[A-Za-z0-9._-]{8,}\b"),
    ("Generic secret assignment", r"(?iu)\b(api[_-]?key|access[_-]?token|secret|password|passwd|private[_-]?key|token)\b\s*[:=]\s*['\"][^'\"]{8,}['\"]"),
]
PERSONAL: list[tuple[str, str]] = [
    ("Email address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("Indian phone number", r"\b(?:\+91[-\s]?)?[6-9]\d{9}\b"),
    ("Aadhaar number", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ("PAN number", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("US SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
]
SHOWN = 220
# --- end of fixed values --------------------------------------------------------------------------------------


def findings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_number (from 1), label, line (its first 220 characters): one row for each match of a pattern and line."""
    rows = docs.select(key, F.posexplode(T.lines("text")).alias("pos", "line")).where(T.squeeze_ends(F.col("line")) != "")
    hits = F.array(*[F.when(F.col("line").rlike(p.replace("(?iu)", "(?iuU)") if p.startswith("(?iu)") else "(?U)" + p), F.lit(label)) for label, p in SECRETS + PERSONAL])
    rows = rows.select(key, "pos", "line", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("label"))
    return rows.select(key, (F.col("pos") + 1).alias("line_number"), "label", F.substring("line", 1, SHOWN).alias("line"))
