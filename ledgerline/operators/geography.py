"""Whether a posting may be worked on from the United States: evidence from its clauses and fields, conflicts, and a decision.

A description's clauses are looked through for mentions, each a predicate (based in, open to, relocate to, ...)
with the text before and behind it. The place that directly follows decides what the clause says: an option
in the States, a foreign restriction, or neither. The signals of all clauses and of the location field then
give conflicts, and the first of an ordered list of conditions that holds gives the outcome.

All of it is one expression in the JVM over one posting's own columns, so that there is no shuffle, and each
text is searched once whatever is filtered on the result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import collapse, let
from ledgerline.operators.gazetteer import ANY, COUNTRIES, COUNTRY_ALIASES, ISO_COUNTRIES, has, places, starts_with_place
from ledgerline.operators.metadata import member, text_of

# Patterns, matched without regard to case.
REMOTE = r"\bremote\b|work (?:from|at) home|home.based"
WORLD = r"\b(?:worldwide|globally remote|global remote|anywhere in the world|work from anywhere|work from any country|remote anywhere)\b"
NORTH = r"\bNorth America(?:n)?\b"
CLOCK = r"\btime[ -]?zones?\b|\bbusiness hours\b|\bUTC[+-]"
INCIDENTAL = r"\b(?:customers?|clients?|headquarters?|partners?|teammates?|colleagues|travel\w*|benefits?|equal.opportunity|privacy|discriminat\w*)\b"
LEGAL = r"equal.opportunity|discriminat|privacy|reasonable accommodation|pursuant to|export.control|for (?:roles|positions|applicants) (?:based|located) in|if you (?:reside|live)|depending on your (?:role|location)|prohibited by law|this requirement does not apply|salary|compensation|pay (?:range|band)|gross annually|hourly rate|excluded from (?:undergoing )?background checks?|exempt (?:from )?background checks?"
ACTOR = r"\b(?:(?:this|the|your) (?:role|position|job)|you(?:'ll| will| must| can)?|candidates?|applicants?|employees?|successful candidate)\b"
LABEL = r"^(?:work(?:ing)? location|location|where you(?: will)? work|eligible locations|eligible countries|remote eligibility|work arrangement|workplace)\s*:"
OPENING = r"^(?:Remote|Work from|Must |Eligible )"
BASED = r"\b(?:based|located|reside|residing|live|work(?:ing)?|performed)\s+(?:(?:remotely|anywhere|only|exclusively)\s+)*(?:in|within|from|at|out of)\s+(?:(?:the|our|either|an?)\s+)*"
MUST = r"\b(?:must|need to|required to|have to)\s+(?:currently\s+)?(?:be\s+(?:(?:physically|currently)\s+)?(?:based|located|resident|residing)|reside|live|work)\s+(?:in|within|from)\s+(?:the\s+)?"
REMOTE_IN = r"\b(?:remote\s+(?:(?:work|working)\s+)?(?:(?:only|exclusively)\s+)?(?:in|within|from)|eligible\s+anywhere\s+(?:within|in)|(?:only|exclusively)\s+(?:open|available) to (?:candidates|applicants) (?:in|from))\s+(?:the\s+)?"
OFFER = r"\b(?:open to|available to|accepting|hiring (?:for this role )?(?:across|in)|eligible (?:locations|countries)|remote)\s*[:(—–-]?\s*(?:(?:candidates|applicants|residents|people)\s+)?(?:(?:based|located|living|residing)\s+)?(?:(?:in|from|across)\s+)?(?:the\s+)?"
PROHIBITED = r"\b(?:not (?:open|available|eligible)(?:\s+(?:for|to|in))?|cannot (?:work|be based) (?:in|from)|do not (?:hire|accept)|(?:excluding|except|excludes)|no (?:candidates|applicants) (?:in|from))\s+(?:(?:candidates|applicants|residents)\s+)?(?:(?:in|from)\s+)?(?:the\s+)?(?:United States|USA|(?-i:US))(?!\w)|\b(?:(?-i:US)|United States) (?:work|employment|applicants?) (?:is |are )?(?:prohibited|not (?:permitted|allowed|eligible))\b"
RELOCATE = r"\brelocat(?:e|ing|ion)(?:\s+[\w'-]+){0,8}?\s+to\s+(?:the\s+)?"
NEGATION = r"\b(?:not|never|no|cannot|can't|without)\b"
OTHER_HYBRID = r"\bhybrid (?:role (?:at the intersection|combining|blending)|engineering|data.science|cloud|architecture)"
OFFICE = r"\bon[ -]?site\b|\bhybrid (?:work(?:ing)? (?:model|schedule|arrangement)|schedule|arrangement|office)\b|\boffice.based\b|required office days|office.{0,35}days (?:per|a|every|each) week"
UNCERTAIN_FIELD = r"\b(?:headquarters?|HQ|recruiting|market|territory|any city|any location)\b"
SOFT = r"\b(?:prefer(?:red|ably|ence)?|should|would like|future|after graduation)\b"
BRIDGE = r"\s*(?:(?:is|are|will|must|can|may|be|currently|physically|primarily|remotely|expected|required|to|only|also|able|need|needs|have|has)\s+)*$"
WORK_SITE = r"\b(?:hybrid|on[ -]?site)\s+(?:(?:work|working|office)\s+)?(?:schedule|arrangement|model|role|position|job)\s+(?:in|at)\s+|\b(?:role|position|job)\s+(?:is|will be)\s+(?:fully\s+)?(?:on[ -]?site|office.based)\s+(?:in|at)\s+"
ANY_CANDIDATES = r"\b(?:consider|accept|welcome|hire) (?:remote )?(?:candidates|applicants) (?:based |located )?(?:in|from) any (?:location|country)\b"
ATTENDANCE = r"\b(?:candidates|applicants|employees) (?:currently )?(?:residing|based|located) in [^.!?]{0,100}\b(?:must|will|are required to) (?:attend|visit|come to)\b"
REMOTE_ROLE = r"\b(?:this|the|your) (?:role|position|job)\b[^.!?]{0,150}?\b(?:is|will be|can be|may be)\s+(?:fully\s+)?remote\s+(?:across|within|in|from)\s+(?:the\s+)?"
COMMUTE = r"\b(?:reside|live|be based|be located)\s+within\s+(?:a\s+)?(?:reasonable\s+)?commut(?:ing|able)\s+distance\s+(?:of|from|to)\s+(?:our\s+)?"
COUNTRY_RATES = r"\brates (?:vary|differ).{0,40}country\b|\bif you are based elsewhere\b"
UNCLEAR_POLICY = r"rates (?:vary|differ).{0,40}country|if you are based elsewhere|work from wherever|remote working location|work where you.{0,25}(?:productive|best)|if you are applying for this role outside of the primary location"
AUTHORISED = (
    r"(?:\b(?:applicants?|candidates?|you|successful candidate)\s+(?:must|need to|are required to)\s+|(?:^|[•●])\s*must\s+)(?:currently\s+)?(?:be\s+)?(?:(?:legally|currently|permanently)\s+)*(?:authorized|authorised|eligible)\s+(?:to work(?: for any employer)?|for employment)\s+in\s+(?:the\s+)?(?:United States|USA|(?-i:US))\b"
    r"|\b(?:(?:this|the) (?:role|position|job) requires|(?:applicants?|candidates?|you) (?:must have|need|are required to have)|^must have)\s+(?:(?:valid|permanent|current|unrestricted|legal)\s+)*(?:United States|USA|(?-i:US)) (?:work authorization|work authorisation|employment eligibility)\b"
    r"|\b(?:continued )?employment in this (?:position|role|job) is contingent (?:on|upon) (?:obtaining|having) (?:valid )?(?:United States|USA|(?-i:US)) work authori[sz]ation\b"
    r"|\ball (?:persons|employees) hired (?:will be|are) required to verify (?:identity and )?eligibility to work in (?:the )?(?:United States|USA|(?-i:US))\b"
)
AUTHORISED_IF = r"\b(?:if|when|for)\b.{0,70}\b(?:US|United States|USA)\b|^(?:US|United States|USA)[ -](?:based )?(?:applicants?|candidates?|roles?|positions?)\b"
WINDOW_END = r"[;.!?]|\b(?:office|serving|supporting|collaborat\w*|reporting|customers?|clients?|with|for our|to serve|business hours|time zones?|travel\w*|and includes|and involves)\b"
NOT_A_SITE = r"\b(?:hours|time.?zone|customers?|clients?|team|business|authorization|clearance)\b"
OTHERS = r"\b(?:who|whose|manager|director|team|department)\b"
RELATIVE = r"\b(?:who|whose|which|that)\b"
OTHER_COUNTRIES = r"\b(?:or other|and other|other eligible) (?:international|global|remote) (?:locations|countries)\b"
BOUNDED = r"\b(?:only|restricted to|within)\b"
FREELANCE = r"\b(?:freelance|freelancer|independent contractor|contributors?|language experts?|data annotat\w*)\b"
LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"

#: The longest target of a predicate, and how far back a negation reaches.
WINDOW, NEAR = 160, 35
_MARK = "\x01"
_NAMES = "array<string>"


def clauses(text: Column) -> Column:
    """Lines, and sentences before a capital letter, without bullets, with single spaces; none is empty."""
    parts = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("U.S."), F.lit("United States")), LINE_ENDS + r"|(?<=[.!?])(?U)\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda c: collapse(F.regexp_replace(c, r"^[ \-•\t]+|[ \-•\t]+$", ""))), lambda c: c != "")


def spans(text: Column, pattern: str) -> Column:
    """An array of (before, match, after) of all matches, in order. U+0001 in the text is lost."""
    marked = F.split(F.regexp_replace(F.translate(text, _MARK, ""), f"{ANY}(?:{pattern})", f"{_MARK}$0{_MARK}"), _MARK)

    def cut(parts: Column) -> Column:
        """Every second part is a match."""
        joined = lambda a, n: F.array_join(F.slice(parts, a, n), "")
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), lambda k: k < F.size(parts))
        return F.transform(places, lambda k: F.struct(joined(F.lit(1), k).alias("before"), F.get(parts, k).alias("match"), joined(k + 2, F.size(parts)).alias("after")))

    return let(marked, cut)


def window(text: Column) -> Column:
    """What a predicate's place can be looked for in: up to the next clause or party, WINDOW characters at most."""
    return F.substring(F.get(F.split(text, ANY + WINDOW_END, 2), F.lit(0)), 1, WINDOW)


def negated_near(before: Column) -> Column:
    return has(F.right(before, F.lit(NEAR)), NEGATION)


def authorisations(clause: Column) -> Column:
    """Spans in which an employee must be allowed to work in the States; conditional and incidental ones are left out."""

    def counts(s: Column) -> Column:
        before = F.when(s["match"].rlike(r"(?U)^\s*[•●]"), "").otherwise(s["before"])
        return ~(has(before, INCIDENTAL) | has(before, NEGATION) | has(before, AUTHORISED_IF))

    return F.filter(spans(clause, AUTHORISED), counts)


def _first(*arrays: Column) -> Column:
    """The first array that is not empty."""
    out = F.array().cast(_NAMES)
    for a in reversed(arrays):
        out = F.when(F.size(a) > 0, a).otherwise(out)
    return out


def _mentions(c: Column, b: Column) -> Column:
    """(kind, after): predicates of a clause that count, with what follows them."""
    spared = lambda s: F.exists(b["authorised"], lambda a: (F.length(a["before"]) <= F.length(s["before"])) & (F.length(s["before"]) < F.length(a["before"]) + F.length(a["match"])))
    plain = lambda s: ~(negated_near(s["before"]) | has(s["before"], SOFT) | has(s["before"], INCIDENTAL) | has(s["before"], OTHERS)) & ~spared(s)
    goes_on = ~b["attendance"]
    stated = goes_on & b["context"]
    scoped = lambda s: F.coalesce(F.nullif(F.regexp_extract(s["before"], f"(?s){ANY}^.*({ACTOR}.*)$", 1), F.lit("")), s["before"])
    kinds: list[tuple[str, str, Column, Callable[[Column], Column]]] = [
        ("role", REMOTE_ROLE, F.lit(True), lambda s: ~has(s["match"], NEGATION) & ~has(s["match"], RELATIVE)),
        ("commute", COMMUTE, b["context"], lambda s: ~has(scoped(s), INCIDENTAL) & ~negated_near(scoped(s))),
        ("relocate", RELOCATE, goes_on, lambda s: ~has(s["match"], NEGATION) & ~negated_near(s["before"])),
        ("based", BASED, stated, lambda s: plain(s) & (b["label"] | has(s["before"], ACTOR + BRIDGE))),
        ("must", MUST, stated, plain),
        ("remote_in", REMOTE_IN, stated, plain),
        ("offer", OFFER, stated & (b["label"] | ~b["incidental"]), plain),
        ("site", WORK_SITE, stated & ~b["incidental"] & ~b["other_hybrid"], lambda s: ~negated_near(s["before"])),
    ]
    none = F.array().cast("array<struct<kind:string,after:string>>")
    item = lambda kind, after: F.struct(F.lit(kind).alias("kind"), after.alias("after"))

    def of_kind(kind: str, pattern: str, where: Column, counts: Callable[[Column], Column]) -> Column:
        return F.when(where, F.transform(F.filter(spans(c, pattern), counts), lambda s: item(kind, s["after"]))).otherwise(none)

    first = F.get(spans(c, ANY_CANDIDATES), F.lit(0))
    anyone = F.when(goes_on & b["anyone"] & ~b["anyone_negated"] & b["anyone_bounded"], F.array(item("anyone", F.regexp_replace(first["after"], ANY + r"^\s+(?:in|within|across)\s+", "")))).otherwise(none)
    label = F.when(stated & b["label"], F.array(item("label", b["label_rest"]))).otherwise(none)
    office = F.when(stated & b["label"] & b["office"] & ~b["other_hybrid"], F.array(item("office", c))).otherwise(none)
    return F.flatten(F.array(*(of_kind(*k) for k in kinds), anyone, label, office))


def _placed(m: Column) -> Column:
    """A mention with its place; null if it does not directly name one."""
    free = m["kind"].isin("label", "office")

    def named(w: Column) -> Column:
        def kept(p: Column) -> Column:
            north = F.when(m["kind"] == "label", has(m["after"], NORTH)).otherwise(has(w, NORTH))
            some = p["us"] | north | (F.size(p["countries"]) + F.size(p["regions"]) + F.size(p["cities"]) > 0)
            return F.when(some, F.struct(m["kind"].alias("kind"), p["us"].alias("us"), north.alias("north"), p["countries"].alias("countries"), p["regions"].alias("regions"), p["cities"].alias("cities")))

        return F.when(free | starts_with_place(w) & ~has(w, NOT_A_SITE), let(places(w), kept))

    return let(F.when(m["kind"] == "office", m["after"]).otherwise(window(m["after"])), named)


def _judged(p: Column, b: Column) -> Column:
    """(option, fixed, foreign, unclear): what a placed mention says of its clause; foreign is a list of names."""
    kind, allowed = p["kind"], ~b["prohibited"]
    option = F.when(kind.isin("anyone", "relocate", "site"), p["us"]).when(kind == "commute", p["us"] & allowed).when(kind == "office", F.lit(False)).otherwise((p["us"] | p["north"]) & allowed)
    predicate = kind.isin("based", "must", "remote_in", "offer")
    hedged = b["soft"] | b["other_countries"]
    names = (
        F.when(kind == "anyone", _first(p["countries"], p["regions"]))
        .when((kind == "site") | (kind == "office") & ~p["us"], _first(p["countries"], p["cities"]))
        .when(predicate & ~hedged & ((kind != "offer") | b["remote"]), _first(p["countries"], p["cities"], p["regions"]))
        .otherwise(F.array().cast(_NAMES))
    )
    unclear = predicate & hedged & (F.size(p["countries"]) + F.size(p["regions"]) + F.size(p["cities"]) > 0)
    fixed = (kind == "based") & ~b["either"]
    return F.struct(option.alias("option"), (option & fixed).alias("fixed"), F.when(option, F.array().cast(_NAMES)).otherwise(names).alias("foreign"), (~option & unclear).alias("unclear"))


def clause_signals(c: Column, remote_mode: Column) -> Column:
    """What one clause says: option, fixed, foreign (names), unclear, prohibited, authorised."""
    found = lambda name, pattern: has(c, pattern).alias(name)
    label_rest = F.regexp_extract(c, f"(?s){ANY}{LABEL}(.*)$", 1)
    anyone, world, ban = (F.get(spans(c, p), F.lit(0)) for p in (ANY_CANDIDATES, WORLD, PROHIBITED))
    context = has(c, ACTOR) | has(c, LABEL) | has(c, OPENING)
    own_words = context | c.rlike(r"^(?:US|United States) (?:work|employment|applicants?)")
    flags = F.struct(
        context.alias("context"), found("label", LABEL), label_rest.alias("label_rest"), found("incidental", INCIDENTAL), found("prohibited", PROHIBITED),
        found("attendance", ATTENDANCE), found("other_hybrid", OTHER_HYBRID), found("office", OFFICE), found("remote", REMOTE), found("soft", SOFT),
        found("other_countries", OTHER_COUNTRIES), found("either", r"\b(?:can|may|either|or)\b"), found("unclear_policy", UNCLEAR_POLICY), authorisations(c).alias("authorised"),
        (has(c, ANY_CANDIDATES) & (remote_mode | has(c, REMOTE))).alias("anyone"), F.coalesce(has(anyone["after"], r"^\s+(?:in|within|across)\s+"), F.lit(False)).alias("anyone_bounded"),
        F.coalesce(negated_near(anyone["before"]), F.lit(False)).alias("anyone_negated"),
        (has(c, PROHIBITED) & own_words & ~F.coalesce(has(ban["before"], INCIDENTAL), F.lit(False))).alias("banned"),
        (has(c, WORLD) & (has(c, REMOTE) | has(c, "work from")) & ~has(c, r"anywhere (?:in|within)\s+(?!the world)") & ~has(c, r"\b(?:days per year|days of the year|up to|\d+ days)\b") & ~has(c, PROHIBITED) & ~F.coalesce(negated_near(world["before"]), F.lit(False))).alias("world"),
    )

    def judged(b: Column) -> Column:
        def summed(all_of: Column) -> Column:
            goes_on, some = ~b["attendance"], lambda name: F.exists(all_of, lambda x: x[name])
            own = b["context"] & ~b["incidental"]
            option = some("option") | goes_on & (b["anyone"] & ~b["anyone_bounded"] & ~b["prohibited"] & ~b["anyone_negated"] | b["world"] & own)
            unclear = b["attendance"] | some("unclear") | b["other_hybrid"] | b["unclear_policy"] | b["world"] & ~own
            return F.struct(
                c.alias("text"), option.alias("option"), some("fixed").alias("fixed"), F.array_distinct(F.flatten(F.transform(all_of, lambda x: x["foreign"]))).alias("foreign"),
                unclear.alias("unclear"), (goes_on & b["banned"]).alias("prohibited"), (F.size(b["authorised"]) > 0).alias("authorised"),
            )

        placed = F.array_compact(F.transform(_mentions(c, b), _placed))
        return let(F.transform(placed, lambda p: _judged(p, b)), summed)

    return let(flags, judged)


def _proof(field: str, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"))


@lru_cache(maxsize=2)
def _assessment(application: str) -> Column:
    """The expression, which is built once for an application: it is large, and every part of it is a call to the JVM."""
    payload = F.when(F.col("source") == "lever", F.try_parse_json("payload_json"))
    iso = F.upper(text_of(member(payload, "$.country")))
    workplace = text_of(member(payload, "$.workplaceType"))
    more = F.transform(F.try_variant_get(payload, "$.categories.allLocations", "array<variant>"), text_of)
    listed = F.concat(F.array(F.nullif(F.col("location"), F.lit(""))), F.coalesce(F.filter(more, lambda x: F.trim(x) != ""), F.array().cast(_NAMES)))
    title = F.coalesce(F.col("title"), F.lit(""))
    behind = F.split(title, r"(?U)\s[-—–|]\s")
    qualifier = F.array_join(F.concat(F.regexp_extract_all(title, F.lit(r"\(([^()]*)\)"), F.lit(1)), F.slice(behind, 2, F.size(behind))), " ; ")

    def fields(locations: Column) -> Column:
        def read(field: Column) -> Column:
            mode = F.when(has(field, REMOTE) | F.coalesce(workplace == "remote", F.lit(False)), "remote")
            mode = mode.when(has(field, r"\bhybrid\b") | F.coalesce(workplace == "hybrid", F.lit(False)), "hybrid").when(has(field, OFFICE) | F.coalesce(workplace == "onsite", F.lit(False)), "onsite").otherwise("unspecified")
            return F.struct(locations.alias("locations"), field.alias("field"), mode.alias("mode"), places(field).alias("structured"), iso.alias("iso"), workplace.alias("workplace"), qualifier.alias("qualifier"), places(qualifier).alias("titled"))

        return let(F.array_join(locations, " ; "), read)

    def with_clauses(f: Column) -> Column:
        legal = F.filter(clauses(F.col("description")), lambda c: ~has(c, LEGAL))
        return let(F.transform(legal, lambda c: clause_signals(c, f["mode"] == "remote")), lambda signals: _decision(f, signals))

    located = let(F.array_distinct(F.array_compact(listed)), fields)
    return let(located, with_clauses)


def assess(rows: DataFrame, *, name: str = "geography") -> DataFrame:
    """The rows (source, title, location, description, payload_json) with a struct `name`.

    It has outcome, reason, confidence, evidence, us_exceptions, conflicts, countries, regions, work_mode,
    foreign_restrictions and uncertainty_details. Null texts and payloads are as empty ones; country, workplace
    and further locations are read from the payloads of one source alone.
    """
    return rows.withColumn(name, _assessment(rows.sparkSession.sparkContext.applicationId))


def _decision(f: Column, signals: Column) -> Column:
    """Conflicts and outcome from the fields and the clauses' signals."""
    field, structured, iso, titled = f["field"], f["structured"], f["iso"], f["titled"]
    texts = lambda where: F.array_distinct(F.transform(F.filter(signals, where), lambda s: s["text"]))
    as_proof = lambda values: F.transform(values, lambda t: _proof("description", t))
    one = lambda where, value: F.array_compact(F.array(F.when(where, value)))
    foreign_iso = F.coalesce(iso.isin(*ISO_COUNTRIES), F.lit(False))
    by_iso = F.create_map(*[F.lit(x) for pair in ISO_COUNTRIES.items() for x in pair])[iso]
    clock, reliable = has(field, CLOCK), ~has(field, UNCERTAIN_FIELD)
    ban = has(field, PROHIBITED) & ~clock
    us = reliable & ~ban & ~clock & (structured["us"] | has(field, NORTH) | F.coalesce(iso == "US", F.lit(False)))
    world = reliable & ~ban & (has(field, WORLD) | has(field, r"\b(?:global|anywhere)\b") & (f["mode"] == "remote"))
    shown_field = F.when(field != "", field).otherwise(F.concat(F.lit("country="), iso))
    seen = F.struct(
        F.concat(one(us | world, _proof("location", shown_field)), as_proof(texts(lambda s: s["option"]))).alias("positive"),
        texts(lambda s: F.size(s["foreign"]) > 0).alias("foreign"),
        F.concat(as_proof(texts(lambda s: s["prohibited"])), one(ban, _proof("location", field))).alias("prohibited"),
        texts(lambda s: s["unclear"]).alias("unclear"),
        texts(lambda s: s["authorised"]).alias("authorised"),
        F.exists(signals, lambda s: s["fixed"]).alias("fixed"),
        F.array_distinct(F.flatten(F.transform(signals, lambda s: s["foreign"]))).alias("names"),
        us.alias("us"), world.alias("world"), clock.alias("clock"),
        has(field, BOUNDED).alias("bounded"), has(field, REMOTE).alias("remote_field"),
        (F.size(structured["countries"]) > 0).alias("country"), (F.size(structured["regions"]) > 0).alias("region"), (F.size(structured["cities"]) > 0).alias("city"),
    )

    def decided(s: Column) -> Column:
        positive, foreign, prohibited = F.size(s["positive"]) > 0, F.size(s["foreign"]) > 0, F.size(s["prohibited"]) > 0
        tagged = s["country"] | s["region"]
        known = [*dict.fromkeys([*COUNTRIES, *COUNTRY_ALIASES.values()])]
        named = F.array_intersect(s["names"], F.array(*map(F.lit, known)))
        definite = F.exists(s["foreign"], lambda t: has(t, MUST) | has(t, OFFICE) | has(t, REMOTE) & has(t, r"\b(?:only|exclusively|within|restricted to)\b")) | tagged & s["remote_field"] & s["bounded"]
        worksite = foreign | tagged | s["city"] & foreign_iso
        unauthorised = (F.size(s["authorised"]) > 0) & worksite & ~positive & ~prohibited & ~s["us"] & ~s["world"] & ~definite
        conflicts = {
            "raw_country_vs_work_location": F.coalesce(iso == "US", F.lit(False)) & (tagged | s["city"]) | foreign_iso & structured["us"] & ~s["country"],
            "US_work_authorization_vs_foreign_work_location": unauthorised,
            "US_permission_vs_prohibition": prohibited & positive,
            "employee_location_requirements_vs_US_option": foreign & positive,
            "bounded_foreign_field_vs_US_option": positive & ~s["us"] & ~s["world"] & ~s["clock"] & tagged & s["bounded"],
            "US_title_vs_foreign_location": titled["us"] & ~s["us"] & tagged,
            "contradictory_fixed_offices": s["fixed"] & foreign,
            "structured_vs_employee_country": s["country"] & (F.size(named) > 0) & ~F.arrays_overlap(structured["countries"], F.when(F.size(named) > 0, s["names"]).otherwise(F.array(F.lit("")))),
        }
        found = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in conflicts.items()]))
        any_conflict = reduce(or_, conflicts.values())
        only_rates = foreign & F.exists(s["unclear"], lambda t: has(t, COUNTRY_RATES)) & ~s["bounded"] & F.forall(s["foreign"], lambda t: has(t, REMOTE) & ~has(t, r"\b(?:must|need|needs|required|only|exclusively|restricted|office)\b"))
        remote_tag = (tagged | foreign_iso) & ((f["mode"] == "remote") | has(F.coalesce(F.col("description"), F.lit("")), REMOTE))
        boundary = (s["bounded"] | (f["mode"] == "remote") & s["region"] & s["remote_field"]) & tagged
        corroborated = s["city"] & foreign_iso & F.coalesce(F.array_contains(structured["cities"], by_iso), F.lit(False))
        words = F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(" "), F.coalesce(F.col("description"), F.lit("")))
        weak = s["city"] | s["region"] | (F.size(titled["countries"]) + F.size(titled["cities"]) > 0) | foreign_iso
        # In order: the first that holds decides.
        steps = [
            (any_conflict, "defer", "conflicting_location_evidence", "medium"),
            (prohibited, "exclude", "US_employment_prohibited", "high"),
            (positive, "keep", "US_or_worldwide_work_option", "high"),
            (only_rates, "defer", "remote_policy_or_role_ambiguity", "low"),
            (foreign, "exclude", "explicit_foreign_employee_location", "high"),
            (F.size(s["unclear"]) > 0, "defer", "remote_policy_or_role_ambiguity", "low"),
            (s["clock"], "defer", "work_clock_not_residence_boundary", "low"),
            (has(field, r"\b(?:AMER|Americas)\b"), "defer", "unresolved_Americas_work_option", "medium"),
            (has(field, UNCERTAIN_FIELD), "defer", "unreliable_location_semantics", "low"),
            (s["country"] & has(words, FREELANCE), "defer", "possible_country_market_tag", "low"),
            (and_(remote_tag, boundary), "exclude", "structured_foreign_remote_boundary", "high"),
            (remote_tag, "defer", "foreign_tag_with_unclear_remote_boundary", "medium"),
            (s["country"], "exclude", "structured_foreign_work_location", "high"),
            (corroborated, "exclude", "corroborated_foreign_city", "high"),
            (weak, "defer", "insufficient_location_confidence", "medium"),
            (F.lit(True), "defer", "unknown_work_eligibility", "low"),
        ]
        verdict = lambda o, r, c: F.struct(F.lit(o).alias("outcome"), F.lit(r).alias("reason"), F.lit(c).alias("confidence"))
        decision = reduce(lambda chain, x: chain.when(x[0], verdict(*x[1:])), steps[1:], F.when(steps[0][0], verdict(*steps[0][1:])))
        title_proof = titled["us"] | (F.size(titled["countries"]) + F.size(titled["cities"]) > 0)
        evidence = F.concat(
            F.transform(f["locations"], lambda t: _proof("location", t)),
            one(F.coalesce(iso != "", F.lit(False)), _proof("raw.country", iso)), one(f["workplace"].isNotNull(), _proof("raw.workplaceType", f["workplace"])), one(title_proof, _proof("title.qualifier", f["qualifier"])),
            as_proof(s["foreign"]), F.filter(s["prohibited"], lambda e: e["field"] == "description"), as_proof(s["unclear"]),
            F.when(unauthorised, as_proof(s["authorised"])).otherwise(F.array().cast("array<struct<field:string,value:string>>")),
        )

        def whole(d: Column) -> Column:
            inferred = F.array_compact(F.array(F.when(foreign_iso, by_iso)))
            countries = F.when(d["reason"] == "corroborated_foreign_city", F.array(by_iso)).otherwise(F.array_sort(F.array_union(F.array_union(structured["countries"], named), inferred)))
            details = F.when(d["outcome"] == "defer", F.array_distinct(F.concat(F.array(d["reason"]), found))).otherwise(F.array().cast(_NAMES))
            return F.struct(
                d["outcome"].alias("outcome"), d["reason"].alias("reason"), d["confidence"].alias("confidence"), F.array_distinct(evidence).alias("evidence"), F.array_distinct(s["positive"]).alias("us_exceptions"),
                found.alias("conflicts"), countries.alias("countries"), F.array_sort(F.array_union(structured["regions"], F.array_except(s["names"], F.array(*map(F.lit, known))))).alias("regions"),
                f["mode"].alias("work_mode"), F.concat(as_proof(s["foreign"]), s["prohibited"]).alias("foreign_restrictions"), details.alias("uncertainty_details"),
            )

        return let(decision, whole)

    return let(seen, decided)
