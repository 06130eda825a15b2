"""Text cleaning of scripts and logs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a line or statement.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Prefixes that start a statement in a client log.
STATEMENT_STARTS = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "WITH", "REPLACE",
    "COLLECT", "CALL", "SEL ", "DEL ", "USING", "MERGE",
)

# What a client log prints between statements.
LOG_NOISE = (
    r"\+\-+",
    r"BTEQ\s+\d+",
    r"\d+\s+rows?\s+(?:found|added|changed|removed)",
    r"Total elapsed time",
    r"Current TimeStamp",
    r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}",
    r"Return Code",
    r"PID:",
    r"\d{4}-\d{2}-\d{2}-\d{6}::",
    r"grep:",
    r"Executing",
    r"\|\s*$",
    r"EXEC",
    r"\d+",
    r"BT",
    r"ET",
)

BLOCK_COMMENT = r"(?s)/\*.*?\*/"
START_PATTERN = "(?i)^(?:" + "|".join(STATEMENT_STARTS) + ")"
NOISE_PATTERN = "(?i)^(?:" + "|".join(LOG_NOISE) + ")"
DROPPED_PATTERN = r"^(?:--|\*\*\*|\.)"
CARRIAGE_RETURN_CODE = "_x000[dD]_"
LOCKING = r"(?is)\A(.*?)locking.*?access"
NONSEQUENCED = r"(?is)\A(.*?)nonsequenced.*?transactiontime"
SEQUENCED = r"(?is)\A(.*?)sequenced.*?transactiontime"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip_block_comments(text: Column) -> Column:
    """Remove ``/* */`` comments from a whole text; an unclosed one stays."""
    return F.regexp_replace(text, BLOCK_COMMENT, "")


def is_dropped(line: Column) -> Column:
    """Blank lines, ``--`` and ``***`` lines and client commands, also inside a statement."""
    bare = strip(line)
    return (bare == "") | bare.rlike(DROPPED_PATTERN)


def is_log_noise(line: Column) -> Column:
    return strip(line).rlike(NOISE_PATTERN)


def is_statement_start(line: Column) -> Column:
    return strip(line).rlike(START_PATTERN)


def ends_statement(line: Column) -> Column:
    return strip(line).endswith(";")


def clean_statement(sql: Column) -> Column:
    """Remove carriage-return codes and the first locking and time clauses of a statement."""
    changed = F.regexp_replace(sql, CARRIAGE_RETURN_CODE, " ")
    for clause in (LOCKING, NONSEQUENCED, SEQUENCED):
        changed = F.regexp_replace(changed, clause, "$1 ")
    # The patterns run only over statements that hold one of their words.
    lower = F.lower(sql)
    holds = lower.contains("_x000d_") | lower.contains("locking") | lower.contains("sequenced")
    return F.when(holds, changed).otherwise(sql)
