"""Secrets in texts: fixed patterns, and weaker candidates that are reported only where complementary parts meet.

A credential has parts: an access identifier, a secret, an endpoint. Strong identifiers and secrets are reported by
themselves. Weak ones (too short for the patterns, or an unlabelled random string) are reported when a complementary part
lies in the same scope, a run of lines without a blank one, at any distance: an identifier beside a weak secret, a secret
beside a weak identifier, an endpoint beside either.

Parts are found per text, each within the interval of its scope. In Spark the parts of a scope become the set of roles that occur
there, three at most, and candidates meet that row: work and rows are in proportion to the parts, however many share a scope.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.shared import written

KINDS = ("assign", "access", "hex", "weak_access", "weak_secret")
# The patterns of the base kinds.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# The weaker forms.
_WEAK_ACCESS = re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}")
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""")
_BLANK = re.compile(r"\n[^\S\n]*\n")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that do not overlap; a match that fails its length is dropped, not retried.

    The lengths of identifiers and hexadecimal runs are part of their patterns: a longer match cannot start inside a
    shorter run. Those of assigned values are tested afterwards, since a failed match uses up its text.
    """
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return in_order(found)


def in_order(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _random_looking(word: str) -> bool:
    """Three sorts of characters, at least a quarter of them digits or capitals, many different ones."""
    digits = sum(c.isdigit() for c in word)
    capitals = sum(c.isupper() for c in word)
    small = sum(c.islower() for c in word)
    return bool(digits and small and (capitals or digits >= 4) and 4 * (digits + capitals) >= len(word)
                and 2 * len(set(word)) >= min(len(word), 24))


def parts_of(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, bool, int, int, int]]:
    """(role, weak, start, stop, scope) of identifiers, secrets and endpoints; nothing where no weak candidate is.

    Weak candidates that overlap a base span are none.
    """
    taken, weak = sorted((a, b) for _, a, b in base), []
    for role, pattern in (("access", _WEAK_ACCESS), ("secret", _WEAK_SECRET)):
        place = 0
        for m in pattern.finditer(text):
            if role == "secret" and not _random_looking(m.group()):
                continue
            while place < len(taken) and taken[place][1] <= m.start():
                place += 1
            if not any(a < m.end() for a, _ in taken[place:place + 4]):
                weak.append((role, True, m.start(), m.end()))
    ids = {(a, b) for role, _, a, b in weak if role == "access"}
    weak = [w for w in weak if w[0] == "access" or (w[2], w[3]) not in ids]
    if not weak:
        return []
    strong = [("access" if k == "access" else "secret", False, a, b) for k, a, b in base]
    ends = [(("endpoint", False, m.start(), m.end())) for m in _ENDPOINT.finditer(text)] if "://" in text else []
    breaks = [m.start() for m in _BLANK.finditer(text)]
    out, scope = [], 0
    for part in sorted([*weak, *strong, *ends], key=lambda p: p[2]):
        while scope < len(breaks) and breaks[scope] < part[2]:
            scope += 1
        out.append((*part, scope))
    return out


_SPAN = "struct<kind:string,start:bigint,stop:bigint>"
_PART = "struct<role:string,weak:boolean,start:bigint,stop:bigint,scope:bigint>"


def _searched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    @F.pandas_udf(f"base array<{_SPAN}>, parts array<{_PART}>")
    def search(column: pd.Series) -> pd.DataFrame:
        bases, parts = [], []
        for text in column:
            text = text if isinstance(text, str) else ""
            base = base_spans(text)
            bases.append([{"kind": k, "start": a, "stop": b} for k, a, b in base])
            parts.append([{"role": r, "weak": w, "start": a, "stop": b, "scope": s} for r, w, a, b, s in parts_of(text, base)])
        return pd.DataFrame({"base": bases, "parts": parts})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("key"),
                       search(F.col(text_col)).alias("found"))
    return rows.select("id", "key", "found.base", "found.parts")


def links(searched: DataFrame) -> DataFrame:
    """``(id, key, scope, role, start, stop, with_roles)``: weak candidates and the complementary roles of their scope, once each,
    from ``searched (id, key, parts)``. Repeated documents count once; candidates without a complement are left out."""
    rows = searched.where(F.size("parts") > 0).select("id", "key", F.explode("parts").alias("p")).select("id", "key", "p.*")
    met = (rows.groupBy("id", "key", "scope").agg(F.collect_set("role").alias("roles")).where(F.size("roles") > 1)
           .withColumnsRenamed({"id": "s_id", "key": "s_key", "scope": "s_scope"}))
    weak = rows.where("weak").drop("weak").distinct()
    same = weak["id"].eqNullSafe(met["s_id"]) & (weak["key"] == met["s_key"]) & (weak["scope"] == met["s_scope"])
    return weak.join(met, same).select(
        "id", "key", "scope", "role", "start", "stop", F.array_sort(F.array_remove("roles", F.col("role"))).alias("with_roles"))


def find(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: its id, and the arrays ``base`` and ``added`` of (kind, start, stop) in code points, by start.

    Null texts count as empty. Rows of one id are told apart by their text; null ids are kept. Very long texts are searched whole, in
    linear time; an empty table gives no rows.
    """
    searched = written(_searched(docs, id_col, text_col), "credential-parts")
    added = (
        links(searched).select("id", "key", F.struct(
            F.concat(F.lit("weak_"), "role").alias("kind"), "start", "stop").alias("span")).distinct()
        .groupBy("id", "key").agg(F.collect_list("span").alias("spans"))
        .withColumnsRenamed({"id": "a_id", "key": "a_key"}))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    added = added.withColumn("spans", F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))
    same = searched["id"].eqNullSafe(added["a_id"]) & (searched["key"] == added["a_key"])
    return searched.join(added, same, "left").select(
        F.col("id").alias(id_col), "base", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("added"))


def all_spans():
    """Both arrays as one, by start and then by kind as listed."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.array_sort(ranked)
