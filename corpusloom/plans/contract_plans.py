"""Queries of the rules that tie fields together. A labelled document's remainder picks one of the cases below: fields put
over a valid record, and the rules that this violates, written down by hand; the oracle looks the expectation up."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.operators import rule_blocks as B
from corpusloom.plans.base import query, table

Case = tuple[Any, str]

PERSON = B.Person("person_status", "configuration", "positions", "focus")
CONTROL = B.Event("control", "control_visibility", "control_actor", "control_target", "control_actor_form", "control_target_form", ("passive", "event_only"), ("object_omitted",))
CHAIN = B.Chain(
    "relevance",
    {"making": ("making_visibility", ("making_actor", "making_target")), "sharing": ("sharing_visibility", ("sharing_actor", "sharing_target")), "showing": ("showing_visibility", ("showing_target",))},
    "authorization", "sharing", "needs_adjudication",
)
ROUTER = B.Router({"validity": ("valid", "noise", "unknown"), "relevance": ("relevant", "not_relevant", "unclear", "not_applicable")} | {s: ("visible", "absent", "unclear", "not_applicable") for s in ("making", "sharing", "showing")}, "i", "validity", "relevance", ("making", "sharing", "showing"))
FORM = B.Form(
    singles={"validity": ("valid", "unknown", "special"), "role": ("actor", "target", "unclear", "other"), "needs_adjudication": ("yes", "no")},
    multis={"cues": ("none", "front", "back", "unclear", "other")}, exclusive={"cues": ("none",)}, noted={"validity": ("special",)}, longest_note=12,
)
SHARED = ("sharing_visibility", "sharing_actor", "sharing_target", "sharing_form", "authorization")
SIDES = {"making_visibility": "making_target", "showing_visibility": "showing_target"}
FORM_CHAIN = B.FormChain("validity", ("speaker", "holder", "relevance", *SIDES, *SIDES.values(), *SHARED), ("speaker", "holder"), "relevance", SIDES, SHARED, ("passive", "nominal"), ("named", "group"))

PERSON_RECORD = {"person_status": "visible", "configuration": "one", "positions": ["front"], "focus": "front"}
PERSON_CASES: Sequence[Case] = (
    ({}, ""),
    ({"person_status": "absent", "configuration": "none", "positions": [], "focus": "no_person_focus"}, ""),
    ({"person_status": "absent"}, "person:absent"),
    ({"person_status": "absent", "configuration": "none", "focus": "no_person_focus"}, "person:absent"),
    ({"configuration": "none"}, "person:visible"),
    ({"configuration": "not_applicable"}, "person:visible"),
    ({"positions": []}, "person:visible"),
    ({"positions": None}, "person:visible"),
    ({"person_status": "unclear", "configuration": "unclear", "focus": "unclear"}, ""),
    ({"person_status": "unclear", "configuration": "unclear"}, "person:unclear"),
    ({"person_status": "not_applicable"}, ""),
)

CONTROL_RECORD = {"control_visibility": "explicit", "control_actor": "front", "control_target": "back", "control_actor_form": "named", "control_target_form": "named", "forms": ["order"]}
UNSEEN_EVENT = {"control_actor": "not_visible", "control_target": "not_visible", "control_actor_form": "not_applicable", "control_target_form": "not_applicable"}
EVENT_CASES: Sequence[Case] = (
    ({}, ""),
    ({"control_actor": "not_visible", "control_actor_form": "passive"}, ""),
    ({"control_actor": "not_visible"}, "control:actor"),
    ({"control_visibility": "implied", "control_actor_form": "event_only"}, "control:actor"),
    ({"control_actor_form": "not_applicable"}, "control:actor"),
    ({"control_target": "not_visible", "control_target_form": "object_omitted"}, ""),
    ({"control_target": "not_visible"}, "control:target"),
    ({"control_target_form": "object_omitted", "control_actor_form": "passive"}, "control:actor|control:target"),
    ({"control_actor_form": None}, "control:actor"),
    ({"control_visibility": "not_applicable", "control_actor": "not_visible"}, ""),
)
CONTROL_CASES: Sequence[Case] = (
    *EVENT_CASES,
    ({"control_visibility": "absent", "forms": ["none_visible"], **UNSEEN_EVENT}, ""),
    ({"control_visibility": "absent", "forms": ["none_visible", "order"], **UNSEEN_EVENT}, "control:forms_absent"),
    ({"control_visibility": "absent", "forms": ["none_visible"]}, "control:absent"),
    ({"control_visibility": "unclear", "forms": ["unclear"], "control_target": "unclear"}, ""),
    ({"control_visibility": "unclear"}, "control:forms_unclear|control:unclear"),
    ({"forms": ["order", "unclear"]}, "control:forms_shown"),
    ({"control_visibility": "implied", "forms": None}, "control:forms_shown"),
)

CHAIN_RECORD = {"relevance": "relevant", "making_visibility": "visible", "making_actor": "front", "making_target": "back", "sharing_visibility": "visible", "sharing_actor": "front", "sharing_target": "back", "showing_visibility": "visible", "showing_target": "back", "authorization": "unclear", "needs_adjudication": False}
CHAIN_OFF = {f: "not_applicable" for f in CHAIN.fields()}
CHAIN_CASES: Sequence[Case] = (
    ({}, ""),
    ({"relevance": "not_relevant", **CHAIN_OFF}, ""),
    ({"relevance": "not_relevant", **CHAIN_OFF, "showing_target": "back"}, "chain:not_relevant"),
    ({"relevance": "not_relevant", **CHAIN_OFF, "authorization": "visible"}, "chain:not_relevant"),
    ({"relevance": "unclear"}, "chain:unclear"),
    ({"relevance": "unclear", "needs_adjudication": True}, ""),
    ({"making_visibility": "not_applicable"}, "chain:making:applicable"),
    ({"making_visibility": "absent", "making_actor": "not_visible"}, "chain:making:absent"),
    ({"making_visibility": "absent", "making_actor": "not_visible", "making_target": "not_visible"}, ""),
    ({"showing_visibility": "unclear"}, "chain:showing:unclear"),
    ({"showing_visibility": "unclear", "showing_target": "unclear"}, ""),
    ({"sharing_visibility": "absent", "sharing_actor": "not_visible", "sharing_target": "not_visible"}, "chain:authorization_absent"),
    ({"authorization": "not_applicable"}, "chain:authorization_visible"),
    ({"sharing_visibility": None}, "chain:sharing:applicable"),
)

ROUTER_RECORD = {"i": 3, "validity": "valid", "relevance": "relevant", "making": "visible", "sharing": "absent", "showing": "unclear"}
STAGES_OFF = dict.fromkeys(ROUTER.stages, "not_applicable")
ROUTER_CASES: Sequence[Case] = (
    ({}, ""),
    ({"i": True}, "index"),
    ({"i": 0}, "index"),
    ({"i": 1.0}, "index"),
    ({"i": "3"}, "index"),
    ({"more": 1}, "keys"),
    ({"making": "shown"}, "enum:making"),
    ({"making": None}, "enum:making"),
    ({"relevance": "not_relevant", **STAGES_OFF}, ""),
    ({"relevance": "not_relevant"}, "not_relevant"),
    ({"sharing": "not_applicable"}, "relevant"),
    ({"relevance": "unclear", **dict.fromkeys(ROUTER.stages, "unclear")}, ""),
    ({"relevance": "unclear"}, "unclear"),
    ({"relevance": "not_applicable"}, "valid_without_relevance"),
    ({"validity": "noise", "relevance": "not_applicable", **STAGES_OFF}, ""),
    ({"validity": "noise", "relevance": "not_applicable"}, "nonvalid"),
    ("[3]", "json"),
    ('{"i": 3', "json"),
)

FORM_RECORD = {"validity": "valid", "role": "actor", "needs_adjudication": "no", "cues": ["front"], "evidence_notes": ""}
FORM_CASES: Sequence[Case] = (
    ({}, ""),
    ({"status": "draft", "role": "", "cues": []}, ""),
    ({"role": ""}, "complete:role"),
    ({"cues": []}, "complete:cues"),
    ({"role": "boss"}, "option:role"),
    ({"status": "draft", "role": "boss"}, "option:role"),
    ({"cues": ["back", "front", "back"]}, ""),
    ({"cues": ["none", "front"]}, "exclusive:cues"),
    ({"cues": ["none", "none"]}, ""),
    ({"cues": "front"}, "complete:cues|option:cues"),
    ({"validity": "special"}, "note"),
    ({"validity": "special", "evidence_notes": "seen in line two"}, ""),
    ({"validity": "unknown", "evidence_notes": " \n"}, "note"),
    ({"cues": ["other"]}, "note"),
    ({"role": "unclear"}, "adjudication"),
    ({"cues": ["front", "unclear"], "needs_adjudication": "yes"}, "note"),
    ({"role": "unclear", "needs_adjudication": "yes", "evidence_notes": "two names"}, ""),
    ({"status": "sent"}, "status"),
)

LINKED_RECORD = {"validity": "valid", "speaker": "front", "holder": "not_visible", "relevance": "relevant", "making_visibility": "visible", "making_target": "back", "showing_visibility": "absent", "showing_target": "not_visible", "sharing_visibility": "visible", "sharing_actor": "front", "sharing_target": "back", "sharing_form": "named", "authorization": "absent"}
LINKED_OFF = {f: "not_applicable" for f in FORM_CHAIN.fields()}
LINKED_CASES: Sequence[Case] = (
    ({}, ""),
    ({"validity": "noise"}, "nonvalid"),
    ({"validity": "noise", **{f: "not_applicable" for f in FORM_CHAIN.semantic}}, ""),
    ({"speaker": "not_applicable"}, "person"),
    ({"relevance": "not_applicable"}, "relevance"),
    ({"relevance": "not_relevant", **LINKED_OFF}, ""),
    ({"relevance": "not_relevant"}, "not_relevant"),
    ({"relevance": "unclear", **{f: "unclear" for f in FORM_CHAIN.fields()}}, ""),
    ({"relevance": "unclear", **LINKED_OFF}, "unclear"),
    ({"making_visibility": "not_applicable"}, "side:making_visibility"),
    ({"showing_target": "back"}, "side:showing_visibility"),
    ({"making_visibility": "unclear"}, "side:making_visibility"),
    ({"making_target": "not_applicable"}, "side:making_visibility"),
    ({"sharing_visibility": "absent"}, "shared:absent"),
    ({"sharing_visibility": "absent", "sharing_actor": "not_visible", "sharing_target": "not_visible", "sharing_form": "not_applicable", "authorization": "not_applicable"}, ""),
    ({"sharing_visibility": "unclear", "sharing_actor": "unclear"}, "shared:unclear"),
    ({"sharing_visibility": "not_applicable"}, "shared:visibility"),
    ({"authorization": "not_applicable"}, "shared:applicable"),
    ({"sharing_actor": "not_visible"}, "shared:wording"),
    ({"sharing_actor": "not_visible", "sharing_form": "nominal"}, ""),
    ({"sharing_actor": "unclear"}, "shared:wording"),
    ({"sharing_form": "passive"}, "shared:wording"),
)


def schema_of(record: dict) -> str:
    kinds = {list: "array<string>", bool: "boolean"}
    return "struct<" + ", ".join(f"{k}:{kinds.get(type(v), 'string')}" for k, v in record.items()) + ">"


def _register(key: str, record: dict, cases: Sequence[Case], violated: Callable[[Column], Column]):
    raws = [c if isinstance(c, str) else json.dumps({**record, **c}) for c, _ in cases]
    expected = ", ".join(f"'{codes}'" for _, codes in cases)

    @query(key, f"select doc_id, ([{expected}])[(doc_id % {len(cases)} + 1)::bigint] as violations from labels")
    def run(spark, sf):
        raw = F.element_at(F.array(*[F.lit(r) for r in raws]), (F.col("doc_id") % len(raws) + 1).cast("int"))
        return table(spark, sf, "labels").select("doc_id", raw.alias("raw")).select("doc_id", F.array_join(violated(F.col("raw")), "|").alias("violations"))


def _block(key: str, record: dict, cases: Sequence[Case], rules: Callable[[Column], Sequence[B.Rule]]):
    _register(key, record, cases, lambda raw: B.broken(rules(F.from_json(raw, schema_of(record)))))


def _form(raw: Column) -> Column:
    status = F.coalesce(F.get_json_object(raw, "$.status"), F.lit("reviewed"))
    return B.broken(B.form_rules(B.form_record(raw, FORM), status, FORM))


_block("con_6", PERSON_RECORD, PERSON_CASES, lambda r: B.person_block(r, PERSON))
_block("con_7", CONTROL_RECORD, EVENT_CASES, lambda r: B.event_block(r, CONTROL))
_block("con_8", CONTROL_RECORD, CONTROL_CASES, lambda r: B.control_block(r, CONTROL, "forms"))
_block("con_9", CHAIN_RECORD, CHAIN_CASES, lambda r: B.chain_block(r, CHAIN))
_register("con_24", ROUTER_RECORD, ROUTER_CASES, lambda raw: B.router_item(raw, ROUTER))
_register("con_28", FORM_RECORD, FORM_CASES, _form)
_block("con_29", LINKED_RECORD, LINKED_CASES, lambda r: B.form_chain(r, FORM_CHAIN))
