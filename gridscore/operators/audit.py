"""Release checks: sensitive text and file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.session import small_table, strings

# Label and pattern of text that must not be published.
GENERIC_PATTERNS = (
    ("google key", r"AIza[0-9A-Za-z_-]{20,}"),
    ("secret key", r"sk-[0-9A-Za-z_-]{20,}"),
    ("bearer token", r"Bearer [0-9A-Za-z._-]{20,}"),
    ("private key block", r"BEGIN (?:RSA |EC |OPENSSH )?PRIV(?:ATE)? KEY"),
    ("service_account", r"(?i)service_account"),
    ("service-account", r"(?i)service-account"),
    ("client_email", r"(?i)client_email"),
    ("client-email", r"(?i)client-email"),
    ("private_key", r"(?i)private_key"),
    ("private-key", r"(?i)private-key"),
    ("old-secret", r"(?i)old-secret"),
    ("secret-token", r"(?i)secret-token"),
    ("windows drive", r"C:\\"),
    ("windows drive slash", r"C:/"),
    ("users folder", r"/Users/"),
    ("home folder", r"/home/"),
)
PRIVATE_PATTERNS = (
    ("project id", r"(?i)\bproject-[0-9a-f]{8}(?:-[0-9a-f]{3,}){3,}\b"),
    ("user profile path", r"(?i)\b[A-Za-z]:[\\/]+Users[\\/]+[^\\/\r\n]+"),
    ("shell start", r"(?i)Start-Process powershell"),
    ("run id setting", r"RUN_ID="),
    ("log setting", r"LOG="),
)


def findings(text: Column, patterns: Sequence[tuple[str, str]] = GENERIC_PATTERNS + PRIVATE_PATTERNS) -> Column:
    """Labels of all patterns found; a text with a NUL counts as binary and is skipped."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(pattern), label) for label, pattern in patterns]))
    return F.when(F.contains(text, F.lit("\x00")), F.array().cast("array<string>")).otherwise(hits)


def path_audit(paths: DataFrame, required: Sequence[str], blocked: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Paths with a verdict: missing (required), blocked (exact or below), unexpected.

    ``allowed`` holds regular expressions. The lists are constants; only the required paths are
    looked up by a join.
    """
    spark = paths.sparkSession
    path = F.col("path")
    is_blocked = F.lit(False)
    for entry in blocked:
        is_blocked = is_blocked | (path == entry) | path.startswith(f"{entry}/")
    is_allowed = F.lit(False)
    for pattern in allowed:
        is_allowed = is_allowed | path.rlike(pattern)
    verdict = F.when(is_blocked, "blocked").when(~is_allowed & ~path.isin(*required), "unexpected")
    present = paths.select("path", verdict.alias("verdict")).where(F.col("verdict").isNotNull())
    missing = small_table(spark, strings("path"), [(entry,) for entry in required]).join(
        paths.select("path").distinct(), "path", "left_anti"
    )
    return present.unionByName(missing.withColumn("verdict", F.lit("missing")))
