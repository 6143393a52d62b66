"""Contracts for nested annotation records, as arrays of violated rules: an empty array is a valid record.

A contract names enum fields, multi-value fields with exclusive sentinels, blocks that one field switches on, and evidence
spans. Every rule is a Column over the parsed record, so a whole contract is one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = "array<struct<span:string,supports:array<struct<field:string,code:string>>>>"
LONGEST_SPAN = 160


@dataclass(frozen=True)
class Contract:
    enums: Mapping[str, Sequence[str]]
    arrays: Mapping[str, Sequence[str]] = field(default_factory=dict)
    exclusive: Mapping[str, Sequence[str]] = field(default_factory=dict)
    #: (validity field, valid value): any other value makes all other enums "not_applicable".
    validity: tuple[str, str] | None = None
    #: stage -> (visibility field, actor field, target field): a stage that is not visible has no actor and no target.
    stages: Mapping[str, tuple[str, str, str]] = field(default_factory=dict)
    #: codes that need no evidence.
    unevidenced: Sequence[str] = ("not_applicable", "absent", "unclear")
    reasons: str | None = "reasons"
    adjudication: str | None = "needs_adjudication"

    def schema(self) -> str:
        own = [f"`{f}` string" for f in self.enums] + [f"`{f}` array<string>" for f in self.arrays]
        own += [f"`{self.adjudication}` boolean"] * bool(self.adjudication) + [f"`{self.reasons}` array<string>"] * bool(self.reasons)
        return "struct<" + ", ".join(x.replace("` ", "`:") for x in own) + f", evidence:{EVIDENCE}>"

    def keys(self) -> list[str]:
        return sorted([*self.enums, *self.arrays, *([self.adjudication] if self.adjudication else []), *([self.reasons] if self.reasons else []), "evidence"])


def _selected(c: Contract, r: Column) -> Column:
    """Pairs of field and code that need evidence."""
    pairs = [F.array(F.struct(F.lit(f).alias("field"), r[f].alias("code"))) for f in c.enums if not c.validity or f != c.validity[0]]

    def codes(f: str) -> Column:
        return F.transform(F.coalesce(r[f], F.array().cast("array<string>")), lambda x: F.struct(F.lit(f).alias("field"), x.alias("code")))

    pairs += [codes(f) for f in c.arrays]
    return F.filter(F.concat(*pairs), lambda p: p["code"].isNotNull() & ~p["code"].isin(list(c.unevidenced)))


def violations(c: Contract, r: Column, title: Column, keys: Column | None = None, require_evidence: bool = True) -> Column:
    """Codes of the rules that a parsed record violates. keys: the names in the raw JSON, since parsing drops unknown ones."""
    rules: list[tuple[str, Column]] = []
    if keys is not None:
        rules.append(("keys", F.array_sort(keys) != F.array(*[F.lit(k) for k in c.keys()])))
    for f, allowed in c.enums.items():
        rules.append((f"enum:{f}", ~F.coalesce(r[f].isin(list(allowed)), F.lit(False))))
    for f, allowed in c.arrays.items():
        a = r[f]
        rules.append((f"array:{f}", a.isNull() | (F.size(F.array_distinct(a)) != F.size(a)) | (F.size(F.array_except(a, F.array(*[F.lit(x) for x in allowed]))) > 0)))
    for f, lone in c.exclusive.items():
        rules.append((f"exclusive:{f}", (F.size(r[f]) > 1) & F.arrays_overlap(r[f], F.array(*[F.lit(x) for x in lone]))))
    if c.validity:
        name, valid = c.validity
        others = [r[f] for f in c.enums if f != name]
        rules.append(("nonvalid_block", (r[name] != valid) & F.exists(F.array(*others), lambda x: x != "not_applicable")))
    for stage, (visibility, actor, target) in c.stages.items():
        shown = r[visibility] == "visible"
        rules.append((f"stage:{stage}", (~shown & ((r[actor] != "not_applicable") | (r[target] != "not_applicable"))) | (shown & ((r[actor] == "not_applicable") | (r[target] == "not_applicable")))))
    if c.adjudication:
        unclear = F.exists(F.array(*[r[f] for f in c.enums]), lambda x: x == "unclear")
        rules.append(("unclear_without_adjudication", unclear & ~F.coalesce(r[c.adjudication], F.lit(False))))
        if c.reasons:
            rules.append(("adjudication_without_reason", F.coalesce(r[c.adjudication], F.lit(False)) & (F.size(F.coalesce(r[c.reasons], F.array().cast("array<string>"))) == 0)))
    evidence = F.coalesce(r["evidence"], F.array().cast(EVIDENCE))
    supported = F.array_distinct(F.flatten(F.transform(evidence, lambda e: e["supports"])))
    rules.append(("evidence_span", F.exists(evidence, lambda e: (F.char_length(e["span"]) == 0) | (F.char_length(e["span"]) > LONGEST_SPAN) | ~F.contains(title, e["span"]))))
    rules.append(("evidence_support", F.size(F.array_except(supported, _selected(c, r))) > 0))
    if require_evidence:
        rules.append(("evidence_missing", F.size(F.array_except(_selected(c, r), supported)) > 0))
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in rules]))


def validated(df: DataFrame, c: Contract, raw: str, title: str, require_evidence: bool = True) -> DataFrame:
    """Adds record, violations, valid, evidence_recall (1 when nothing needs evidence)."""
    out = df.withColumn("record", F.from_json(raw, c.schema()))
    bad = violations(c, F.col("record"), F.col(title), F.json_object_keys(raw), require_evidence)
    out = out.withColumn("violations", F.when(F.col("record").isNull() | F.json_object_keys(raw).isNull(), F.array(F.lit("json"))).otherwise(bad))
    wanted = _selected(c, F.col("record"))
    given = F.flatten(F.transform(F.coalesce(F.col("record.evidence"), F.array().cast(EVIDENCE)), lambda e: e["supports"]))
    recall = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, given)) / F.size(wanted)).otherwise(1.0)
    return out.withColumn("valid", F.size("violations") == 0).withColumn("evidence_recall", recall)


def normalized(df: DataFrame, c: Contract, raw: str, aliases: Mapping[str, str]) -> DataFrame:
    """normalized (JSON) and actions: scalars of array fields become arrays, codes go through the aliases, missing arrays
    become empty; every change leaves a line `action:field`."""
    r = F.from_json(raw, "map<string,string>")
    alias = F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv])
    values, actions = [], []
    for f in c.enums:
        v = r[f]
        values.append(F.coalesce(F.element_at(alias, v), v).alias(f))
        actions.append(F.when(F.element_at(alias, v).isNotNull(), F.lit(f"alias:{f}")))
    for f in c.arrays:
        v = r[f]
        listed = F.from_json(v, "array<string>")
        out = F.when(v.isNull(), F.array().cast("array<string>")).when(v.startswith("["), listed).otherwise(F.array(v))
        mapped = F.array_distinct(F.transform(out, lambda x: F.coalesce(F.element_at(alias, x), x)))
        values.append(mapped.alias(f))
        actions += [F.when(v.isNull(), F.lit(f"missing_array:{f}")), F.when(v.isNotNull() & ~v.startswith("["), F.lit(f"scalar_to_array:{f}")), F.when(mapped != out, F.lit(f"alias:{f}"))]
    return df.withColumn("normalized", F.to_json(F.struct(*values))).withColumn("actions", F.array_compact(F.array(*actions)))


def transport(df: DataFrame, batch: str, items: str, expected: str) -> DataFrame:
    """For each batch: whether the returned indexes are unique numbers and exactly the expected ones, and the items in that order."""
    got = F.transform(F.col(items), lambda x: x["item_index"])
    ok = (F.size(F.array_distinct(got)) == F.size(got)) & (F.array_sort(got) == F.array_sort(F.col(expected)))
    ordered = F.flatten(F.transform(F.col(expected), lambda i: F.filter(F.col(items), lambda x: x["item_index"] == i)))
    return df.select(batch, F.coalesce(ok, F.lit(False)).alias("transport_ok"), F.when(ok, ordered).alias("ordered"))


def recoded(record: Column, fields: Mapping[str, str], codes: Mapping[str, str]) -> Column:
    """A map of compact names and codes under long names, or the other way round with inverted maps."""
    names = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    values = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.transform_values(F.transform_keys(record, lambda k, v: F.coalesce(F.element_at(names, k), k)), lambda k, v: F.coalesce(F.element_at(values, v), v))
