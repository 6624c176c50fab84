"""Rule tables as rows: written from the catalogue, read back from any table, checked by name, compiled once into columns."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as C

#: A rule table is compiled on the driver; one of more rows is refused.
MOST = 5000
SCOPES = ("html", "page")
TABLE = "kind string, id string, place int, name string, weight double, at_least int, scope string, pattern string"


@dataclass(frozen=True)
class Rules:
    """Categories (weight, scope, patterns), combinations (bonus, least hits) and decisive sets of flags, in order."""

    categories: dict = field(default_factory=lambda: C.CATEGORIES)
    combos: list = field(default_factory=lambda: C.COMBOS)
    decisive: dict = field(default_factory=lambda: C.DECISIVE)

    @property
    def digest(self) -> str:
        """A text of 16 characters that differs where the rules do, those of the other lists of the catalogue included."""
        fixed = {k: v for k, v in vars(C).items() if k.isupper() and k not in ("CATEGORIES", "COMBOS", "DECISIVE")}
        return hashlib.sha256(json.dumps([self.categories, self.combos, self.decisive, fixed], sort_keys=True, default=repr).encode()).hexdigest()[:16]


BUILT_IN = Rules()


def check(rules: Rules) -> Rules:
    """The rules, if categories, flags, scopes and weights are known and sound; else ValueError with the fault and its place."""
    flags = {*rules.categories, *C.FORM_FLAGS, *C.URL_FLAGS}
    for name, (weight, scope, patterns) in rules.categories.items():
        if scope not in SCOPES:
            raise ValueError(f"unknown_scope:{name}")
        if not 0 <= weight <= 1:
            raise ValueError(f"invalid_weight:{name}")
        if not patterns or len(set(patterns)) < len(patterns):
            raise ValueError(f"missing_or_repeated_pattern:{name}")
    for i, (bonus, least) in enumerate(rules.combos, 1):
        for name, n in least.items():
            if name not in rules.categories:
                raise ValueError(f"unknown_category:combo{i}:{name}")
            if n < 1:
                raise ValueError(f"invalid_count:combo{i}:{name}")
        if not least or not 0 <= bonus <= 1:
            raise ValueError(f"invalid_weight:combo{i}")
    for name, needs in rules.decisive.items():
        if unknown := [f for f in needs if f not in flags]:
            raise ValueError(f"unknown_flag:{name}:{unknown[0]}")
        if not needs:
            raise ValueError(f"missing_flags:{name}")
    return rules


def check_signatures(signatures: dict, rules: dict) -> None:
    """Front-end rules may only name signature categories that there are."""
    for name, groups in rules.items():
        for group in groups:
            if unknown := [s for s in group if s not in signatures]:
                raise ValueError(f"unknown_signature:{name}:{unknown[0]}")


# What the library ships is checked when it is imported.
check(BUILT_IN)
check_signatures(C.SIGNATURES, C.SIGNATURE_RULES)


def rule_table(spark: SparkSession, rules: Rules = BUILT_IN) -> DataFrame:
    """One row per pattern, per category of a combination and per flag of a decisive rule."""
    rows = [("pattern", f"{name}.{i}", p * 1000 + i, name, float(weight), None, scope, text) for p, (name, (weight, scope, patterns)) in enumerate(rules.categories.items()) for i, text in enumerate(patterns)]
    rows += [("combo", f"combo{p}", p, name, float(bonus), n, None, None) for p, (bonus, least) in enumerate(rules.combos, 1) for name, n in least.items()]
    rows += [("decisive", key, p * 1000 + i, flag, None, None, None, None) for p, (key, needs) in enumerate(rules.decisive.items()) for i, flag in enumerate(needs)]
    return spark.createDataFrame(rows, TABLE)


def read_rules(table: DataFrame, most: int = MOST) -> Rules:
    """The rules that a table holds. Every fault has a name: too_many_rules, unknown_kind, duplicate_rule_id, conflicting_weight, invalid_pattern, and those of ``check``."""
    rows = table.select(*[c.split()[0] for c in TABLE.split(", ")]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"too_many_rules:{most}")
    if odd := next((r for r in rows if r["kind"] not in ("pattern", "combo", "decisive")), None):
        raise ValueError(f"unknown_kind:{odd['kind']}")
    seen = set()
    for r in rows:
        own = (r["kind"], r["id"], r["name"] if r["kind"] != "pattern" else None)
        if own in seen:
            raise ValueError(f"duplicate_rule_id:{r['id']}")
        seen.add(own)
    rows.sort(key=lambda r: (r["place"], r["id"], r["name"]))
    categories: dict = {}
    for r in (r for r in rows if r["kind"] == "pattern"):
        weight, scope, patterns = categories.setdefault(r["name"], (r["weight"], r["scope"], []))
        if (weight, scope) != (r["weight"], r["scope"]):
            raise ValueError(f"conflicting_weight:{r['name']}")
        patterns.append(r["pattern"])
    combos: dict = {}
    for r in (r for r in rows if r["kind"] == "combo"):
        bonus, least = combos.setdefault(r["id"], (r["weight"], {}))
        if bonus != r["weight"]:
            raise ValueError(f"conflicting_weight:{r['id']}")
        least[r["name"]] = r["at_least"]
    decisive: dict = {}
    for r in (r for r in rows if r["kind"] == "decisive"):
        decisive[r["id"]] = (*decisive.get(r["id"], ()), r["name"])
    rules = check(Rules(categories, list(combos.values()), decisive))
    one = table.sparkSession.range(1)
    for name, (_, _, patterns) in categories.items():
        try:
            one.select(*[F.lit(" ").rlike(f"(?id){p}") for p in patterns]).collect()
        except PySparkException as e:
            raise ValueError(f"invalid_pattern:{name}") from e
    return rules
