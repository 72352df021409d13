"""String functions of logs, relations and rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that tell a log line's level, tried in this order.
ERROR_WORDS = ("error", "exception", "fail", "critical")
WARN_WORDS = ("warn", "alert", "notice")

#: time, LEVEL, service and message of a plain log line.
LOG_LINE = r"^\s*(\S+(?: \d{2}:\d{2}:\d{2}\S*)?)\s+([A-Z]+)\s+([\w\-]+)\s+(.*)$"
#: One atom of a rule: relation, subject, object, time variable.
ATOM = r"([^()&<\s-][^()&<]*?)\((X\d+),\s*(X\d+),\s*(T\d+)\)"


def log_level(message: Column) -> Column:
    """ERROR, WARN or UNKNOWN by the words in the message."""
    low = F.lower(message)
    return F.when(low.rlike("|".join(ERROR_WORDS)), "ERROR").when(low.rlike("|".join(WARN_WORDS)), "WARN").otherwise("UNKNOWN")


def log_message(name: Column, value: Column) -> Column:
    return F.concat(name, F.lit(": "), F.coalesce(value.cast("string"), F.lit("")))


def log_line(line: Column) -> Column:
    """A struct (time, level, service, message); null for lines of another form."""
    part = lambda k: F.regexp_extract(line, LOG_LINE, k)
    return F.when(line.rlike(LOG_LINE), F.struct(part(1).alias("time"), part(2).alias("level"), part(3).alias("service"), part(4).alias("message")))


def camel_to_words(name: Column) -> Column:
    """camelCase to lower-case words."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " "))


def clean_relation(name: Column) -> Column:
    """Underscores at the ends go; those inside, and ampersands, become spaces."""
    return F.regexp_replace(F.regexp_replace(name, r"^_+|_+$", ""), r"[_&]", " ")


def safe_name(name: Column) -> Column:
    """Anything but letters, digits, dot, dash and underscore becomes one underscore a run."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def rule_atoms(rule: Column) -> Column:
    """The atoms of a rule in order: structs (rel, sub, obj, time)."""
    part = lambda k: F.regexp_extract_all(rule, F.lit(ATOM), F.lit(k))
    return F.arrays_zip(part(1).alias("rel"), part(2).alias("sub"), part(3).alias("obj"), part(4).alias("time"))


def rule_path(rule: Column) -> Column:
    """head relation and the body's relations joined by ``|``: struct (head, body)."""
    rels = F.regexp_extract_all(rule, F.lit(ATOM), F.lit(1))
    return F.struct(F.get(rels, F.lit(0)).alias("head"), F.array_join(F.slice(rels, 2, F.greatest(F.size(rels) - 1, F.lit(0))), "|").alias("body"))


def strip_columns(line: Column, keep_confidence: bool = True) -> Column:
    """A rule line without its three leading columns; with ``&conf`` behind it if wanted."""
    parts = F.split(line, r"\s+")
    text = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), " ")
    return F.concat(text, F.lit("&"), F.get(parts, F.lit(0))) if keep_confidence else text


def is_chain(rule: Column) -> Column:
    """Whether the body leads from the head's subject to its object and its times don't decrease,
    none after the head's."""
    atoms = rule_atoms(rule)
    head, body = F.get(atoms, F.lit(0)), F.slice(atoms, 2, F.greatest(F.size(atoms) - 1, F.lit(0)))
    number = lambda a: F.substr(a["time"], F.lit(2)).cast("int")
    rest = F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0)))
    steps = F.zip_with(body, rest, lambda a, b: b.isNull() | ((a["obj"] == b["sub"]) & (number(a) <= number(b))))
    first, last = F.get(body, F.lit(0)), F.get(body, F.size(body) - 1)
    ends = (first["sub"] == head["sub"]) & (last["obj"] == head["obj"]) & (number(last) <= number(head))
    return F.coalesce((F.size(body) > 0) & F.forall(steps, lambda x: x) & ends, F.lit(False))


def rule_from_path(path: Column) -> Column:
    """The chain rule text of a head and a body path ``a|b|c``: struct (head, body) -> text."""
    body = F.split(path["body"], r"\|")
    n = F.size(body)
    atom = lambda rel, i: F.concat(rel, F.lit("(X"), i.cast("string"), F.lit(",X"), (i + 1).cast("string"), F.lit(",T"), i.cast("string"), F.lit(")"))
    head = F.concat(path["head"], F.lit("(X0,X"), n.cast("string"), F.lit(",T"), n.cast("string"), F.lit(")"))
    return F.concat(head, F.lit("<-"), F.array_join(F.transform(body, atom), "&"))
