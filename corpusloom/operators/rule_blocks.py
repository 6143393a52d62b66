"""Rules that tie the fields of an annotation record together, as arrays of the codes of violated rules.

A rule is a code, when it applies, and what must hold then. All rules of a block are Columns of one projection, so a record
is read once and every violated rule is reported. A condition that is null doesn't apply; a requirement that is null (a
missing field) is not met."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that the rules give a meaning to; fixed values.
ABSENT, UNCLEAR, INAPPLICABLE, UNSEEN = "absent", "unclear", "not_applicable", "not_visible"
RELEVANT, IRRELEVANT = "relevant", "not_relevant"
SHOWN = ("explicit", "implied")
NO_FORM = "none_visible"

Rule = tuple[str, Column, Column]


def broken(rules: Sequence[Rule]) -> Column:
    """Codes of the rules that apply and are not met, in the order of the rules."""
    no = F.lit(False)
    return F.array_compact(F.array(*[F.when(F.coalesce(when, no) & ~F.coalesce(must, no), F.lit(code)) for code, when, must in rules]))


def _every(columns: Sequence[Column], code: str) -> Column:
    return F.forall(F.array(*columns), lambda x: F.coalesce(x == code, F.lit(False)))


def _any(columns: Sequence[Column], code: str) -> Column:
    return F.exists(F.array(*columns), lambda x: F.coalesce(x == code, F.lit(False)))


def _lone(codes: Column, code: str) -> Column:
    return codes == F.array(F.lit(code))


@dataclass(frozen=True)
class Person:
    status: str
    configuration: str
    positions: str
    focus: str
    nobody: str = "none"
    no_focus: str = "no_person_focus"


def person_block(r: Column, p: Person) -> list[Rule]:
    """An absent person has no configuration, position or focus, a visible one has a configuration and a position, an unclear
    one is unclear in both configuration and focus."""
    status, shape, focus = r[p.status], r[p.configuration], r[p.focus]
    positions = F.size(F.coalesce(r[p.positions], F.array().cast("array<string>")))
    return [
        ("person:absent", status == ABSENT, (shape == p.nobody) & (positions == 0) & (focus == p.no_focus)),
        ("person:visible", status == "visible", ~shape.isin(p.nobody, INAPPLICABLE) & (positions > 0)),
        ("person:unclear", status == UNCLEAR, (shape == UNCLEAR) & (focus == UNCLEAR)),
    ]


@dataclass(frozen=True)
class Event:
    name: str
    visibility: str
    actor: str
    target: str
    actor_form: str
    target_form: str
    omitted_actor: Sequence[str]
    omitted_target: Sequence[str]


def event_block(r: Column, e: Event) -> list[Rule]:
    """The way an actor or target is put into words is one of the omissions exactly if it is not visible."""
    seen, actor, target, actor_form, target_form = (r[f] for f in (e.visibility, e.actor, e.target, e.actor_form, e.target_form))
    shown = seen.isin(*SHOWN)

    def fits(position: Column, form: Column, omitted: Sequence[str]) -> Column:
        return F.when(position == UNSEEN, form.isin(*omitted)).otherwise(~form.isin(*omitted, INAPPLICABLE))

    return [
        (f"{e.name}:absent", seen == ABSENT, _every([actor, target], UNSEEN) & _every([actor_form, target_form], INAPPLICABLE)),
        (f"{e.name}:unclear", seen == UNCLEAR, _any([actor, target, actor_form, target_form], UNCLEAR)),
        (f"{e.name}:actor", shown, fits(actor, actor_form, e.omitted_actor)),
        (f"{e.name}:target", shown, fits(target, target_form, e.omitted_target)),
    ]


def control_block(r: Column, e: Event, forms: str) -> list[Rule]:
    """An event with a list of forms: one lone code says that there are none or that they are unclear."""
    seen, given = r[e.visibility], r[forms]
    empty = F.array(F.lit(NO_FORM), F.lit(UNCLEAR), F.lit(INAPPLICABLE))
    return [
        (f"{e.name}:forms_absent", seen == ABSENT, _lone(given, NO_FORM)),
        (f"{e.name}:forms_unclear", seen == UNCLEAR, _lone(given, UNCLEAR)),
        (f"{e.name}:forms_shown", seen.isin(*SHOWN), ~F.arrays_overlap(given, empty)),
        *event_block(r, e),
    ]


@dataclass(frozen=True)
class Chain:
    """stages: stage -> (visibility field, position fields). authorization belongs to the stage `authorized`."""

    relevance: str
    stages: Mapping[str, tuple[str, Sequence[str]]]
    authorization: str
    authorized: str
    adjudication: str

    def fields(self) -> list[str]:
        return [*chain.from_iterable((v, *positions) for v, positions in self.stages.values()), self.authorization]


def chain_block(r: Column, c: Chain) -> list[Rule]:
    """A chain that is not relevant is inapplicable throughout; one of unclear relevance needs adjudication; in a relevant one
    each stage's positions follow its visibility, and authorization that of its stage."""
    relevance, authorization = r[c.relevance], r[c.authorization]
    decided = ~F.coalesce(relevance.isin(IRRELEVANT, UNCLEAR), F.lit(False))
    rules = [
        ("chain:not_relevant", relevance == IRRELEVANT, _every([r[f] for f in c.fields()], INAPPLICABLE)),
        ("chain:unclear", relevance == UNCLEAR, r[c.adjudication]),
    ]
    for name, (visibility, positions) in c.stages.items():
        seen, held = r[visibility], [r[p] for p in positions]
        rules += [
            (f"chain:{name}:applicable", decided, seen != INAPPLICABLE),
            (f"chain:{name}:absent", decided & (seen == ABSENT), _every(held, UNSEEN)),
            (f"chain:{name}:unclear", decided & (seen == UNCLEAR), _any(held, UNCLEAR)),
        ]
    seen = r[c.stages[c.authorized][0]]
    return [
        *rules,
        ("chain:authorization_absent", decided & (seen == ABSENT), authorization == INAPPLICABLE),
        ("chain:authorization_visible", decided & (seen == "visible"), authorization != INAPPLICABLE),
    ]


def _text(v: Column, name: str) -> Column:
    """The value of a key that holds a string, else null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


@dataclass(frozen=True)
class Router:
    enums: Mapping[str, Sequence[str]]
    index: str
    validity: str
    relevance: str
    stages: Sequence[str]
    valid: str = "valid"


def router_item(raw: Column, c: Router) -> Column:
    """Violations of one JSON item. The index must be a JSON integer of at least 1 (no boolean, fraction, string or number
    beyond 64 bits). What isn't an object, or names a key twice, is `json` alone."""
    v = F.try_parse_json(raw)
    keys = F.json_object_keys(raw)
    value = {f: _text(v, f) for f in c.enums}
    whole = F.schema_of_variant(F.try_variant_get(v, f"$.{c.index}", "variant")) == "BIGINT"
    valid = value[c.validity] == c.valid
    relevance, stages = value[c.relevance], [value[s] for s in c.stages]
    yes = F.lit(True)
    rules = [
        ("keys", yes, F.array_sort(keys) == F.array(*[F.lit(k) for k in sorted([c.index, *c.enums])])),
        ("index", yes, whole & (F.try_variant_get(v, f"$.{c.index}", "bigint") >= 1)),
        *[(f"enum:{f}", yes, value[f].isin(*allowed)) for f, allowed in c.enums.items()],
        ("nonvalid", value[c.validity] != c.valid, _every([x for f, x in value.items() if f != c.validity], INAPPLICABLE)),
        ("valid_without_relevance", valid, relevance != INAPPLICABLE),
        ("not_relevant", valid & (relevance == IRRELEVANT), _every(stages, INAPPLICABLE)),
        ("relevant", valid & (relevance == RELEVANT), ~_any(stages, INAPPLICABLE)),
        ("unclear", valid & (relevance == UNCLEAR), _every(stages, UNCLEAR)),
    ]
    return F.when(v.isNull() | keys.isNull(), F.array(F.lit("json"))).otherwise(broken(rules))


@dataclass(frozen=True)
class Form:
    """A reviewer's form. noted: field -> options that call for a note; the adjudication field is a single one with "yes"."""

    singles: Mapping[str, Sequence[str]]
    multis: Mapping[str, Sequence[str]] = field(default_factory=dict)
    exclusive: Mapping[str, Sequence[str]] = field(default_factory=dict)
    noted: Mapping[str, Sequence[str]] = field(default_factory=dict)
    note: str = "evidence_notes"
    adjudication: str = "needs_adjudication"
    longest_note: int = 2000
    #: options that call for a note in every field but the note and the adjudication.
    vague: Sequence[str] = ("unknown", "other")


def form_record(raw: Column, f: Form) -> Column:
    """The record as it is kept: a missing single option or note is empty, a missing list is empty, repeated items of a list
    are one at their first place, the note is cut at its longest. What isn't a string or list where one is due is null."""
    v = F.try_parse_json(raw)

    def got(name: str, wanted: str, empty: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        given = F.try_variant_get(v, f"$.{name}", "array<string>" if wanted == "ARRAY" else "string")
        return F.when(F.array_contains(F.json_object_keys(raw), name), F.when(F.startswith(kind, F.lit(wanted)), given)).otherwise(empty)

    nothing = F.array().cast("array<string>")
    return F.struct(
        *[got(n, "STRING", F.lit("")).alias(n) for n in f.singles],
        *[F.array_distinct(got(n, "ARRAY", nothing)).alias(n) for n in f.multis],
        F.substring(got(f.note, "STRING", F.lit("")), 1, f.longest_note).alias(f.note),
    )


def form_rules(r: Column, status: Column, f: Form) -> list[Rule]:
    """r: of form_record. A draft may be incomplete and needs no note; its options must be known all the same."""
    yes, done = F.lit(True), status == "reviewed"
    codes = {n: F.array(r[n]) for n in f.singles} | {n: r[n] for n in f.multis}
    allowed = {**f.singles, **f.multis}

    def within(name: str, options: Sequence[str]) -> Column:
        return F.arrays_overlap(codes[name], F.array(*[F.lit(o) for o in options]))

    judged = [n for n in codes if n != f.adjudication]
    asked = r[f.adjudication] == "yes"
    vague = [within(n, f.vague) for n in judged] + [within(n, options) for n, options in f.noted.items()]
    unclear = [within(n, (UNCLEAR,)) for n in judged]
    return [
        ("status", yes, status.isin("draft", "reviewed")),
        *[(f"complete:{n}", done, r[n] != "") for n in f.singles],
        *[(f"complete:{n}", done, F.size(r[n]) > 0) for n in f.multis],
        *[(f"option:{n}", yes, F.size(F.array_except(codes[n], F.array(F.lit(""), *[F.lit(o) for o in allowed[n]]))) == 0) for n in f.singles],
        *[(f"option:{n}", yes, F.size(F.array_except(codes[n], F.array(*[F.lit(o) for o in allowed[n]]))) == 0) for n in f.multis],
        *[(f"exclusive:{n}", (F.size(r[n]) > 1) & within(n, lone), F.lit(False)) for n, lone in f.exclusive.items()],
        ("adjudication", done & F.exists(F.array(*unclear), lambda x: x), asked),
        ("note", done & F.exists(F.array(*vague, asked), lambda x: x), F.trim(F.regexp_replace(r[f.note], r"\s+", " ")) != ""),
    ]


@dataclass(frozen=True)
class FormChain:
    """Fields of a form that depend on each other. sides: visibility -> target position of the stages with a target only;
    shared: the stage with an actor (its visibility, actor, target, actor's form, authorization)."""

    validity: str
    semantic: Sequence[str]
    person: Sequence[str]
    relevance: str
    sides: Mapping[str, str]
    shared: tuple[str, str, str, str, str]
    omitted: Sequence[str]
    visible: Sequence[str]
    valid: str = "valid"

    def fields(self) -> list[str]:
        return [*chain.from_iterable(self.sides.items()), *self.shared]


def form_chain(r: Column, c: FormChain) -> list[Rule]:
    """A record that isn't valid is inapplicable in every field; the persons of a valid one never are; its chain of stages is
    inapplicable or unclear as a whole, or each stage's fields follow its visibility."""
    valid = r[c.validity] == c.valid
    relevance, everything = r[c.relevance], [r[f] for f in c.fields()]
    on = valid & (relevance == RELEVANT)
    seen, actor, target, form, authorization = (r[f] for f in c.shared)
    rules = [
        ("nonvalid", r[c.validity] != c.valid, _every([r[f] for f in c.semantic], INAPPLICABLE)),
        ("person", valid, ~_any([r[f] for f in c.person], INAPPLICABLE)),
        ("relevance", valid, relevance.isin(IRRELEVANT, UNCLEAR, RELEVANT)),
        ("not_relevant", valid & (relevance == IRRELEVANT), _every(everything, INAPPLICABLE)),
        ("unclear", valid & (relevance == UNCLEAR), _every(everything, UNCLEAR)),
    ]
    for visibility, position in c.sides.items():
        shown, held = r[visibility], r[position]
        follows = F.when(shown == ABSENT, held == UNSEEN).when(shown == UNCLEAR, held == UNCLEAR).when(shown == "visible", held != INAPPLICABLE).otherwise(shown != INAPPLICABLE)
        rules.append((f"side:{visibility}", on, follows))
    wording = F.when(actor == UNSEEN, form.isin(*c.omitted)).when(actor == UNCLEAR, form == UNCLEAR).otherwise(form.isin(*c.visible))
    return [
        *rules,
        ("shared:visibility", on, seen.isin(ABSENT, UNCLEAR, "visible")),
        ("shared:absent", on & (seen == ABSENT), _every([actor, target], UNSEEN) & _every([form, authorization], INAPPLICABLE)),
        ("shared:unclear", on & (seen == UNCLEAR), _every([actor, target, form, authorization], UNCLEAR)),
        ("shared:applicable", on & (seen == "visible"), ~_any([actor, target, form, authorization], INAPPLICABLE)),
        ("shared:wording", on & (seen == "visible") & ~_any([actor, target, form, authorization], INAPPLICABLE), wording),
    ]
