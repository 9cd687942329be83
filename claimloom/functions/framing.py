"""How a clause is to be read, from its words alone: Columns over the clause, its predicate and its
spokes (array of struct(role, surface, ...))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the framing rules.
HEDGES = [
    "perhaps", "maybe", "might", "may", "possibly", "probably", "likely", "unlikely", "supposedly", "allegedly", "reportedly", "apparently",
    "presumably", "seemingly", "purportedly", "approximately", "roughly", "about", "somewhat", "sort", "kind", "appear", "appears",
    "appeared", "seem", "seems", "seemed", "believe", "believes", "believed", "claim", "claims", "claimed", "thought", "thinks", "think",
]
NEGATIVE_DETERMINERS = ["no", "none", "neither", "nothing", "nobody"]
REQUEST_OPENERS = ["can you", "could you", "would you", "will you", "would you mind", "could i ask you to"]
COUNTERFACTUAL = r"\b(?:if\s+[a-z]+\s+had\b|if\s+[a-z]+\s+were\b|were\s+to\b|(?:would|could|might|should)\s+have\b)"
HYPERBOLES = [
    "could eat a horse", "moved heaven and earth", "a thousand times", "a million times", "forever and ever", "end of the world",
    "die of embarrassment", "hungry enough to eat", "could kill for", "ten pizzas",
]
HYPERBOLE_NUMBERS = r"\b(?:a\s+)?(?:million|billion|trillion|thousand|hundred)\s+(?:times|years|hours|miles|pounds|dollars|reasons|pizzas)"
COMMANDS = [
    "open", "close", "pass", "give", "take", "go", "come", "stop", "start", "wait", "listen", "look", "see", "hear", "sit", "stand",
    "run", "walk", "speak", "tell", "show", "send", "bring", "put", "call", "answer", "do", "don't",
]
DETERMINERS = ["the", "a", "an", "this", "that", "these", "those", "some", "all", "every", "each", "my", "your", "his", "her", "our", "their", "its"]
INDIRECT = ["said that", "stated that", "claimed that", "reported that", "alleged that"]
YEAR = r"\b(?:1[0-9]|20)\d{2}\b"
PAST_VERBS = ["was", "were", "had", "did", "went", "saw", "took"]


def _words(clause: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(clause), F.lit("[a-z']+"), F.lit(0)))


def _first_word(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"^\s*(\S+)", 1)


def _any_of(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def hedging(clause: Column) -> Column:
    n = F.size(F.array_intersect(_words(clause), F.array(*[F.lit(w) for w in HEDGES])))
    return F.when(n == 0, "none").when(n == 1, "light").when(n <= 3, "moderate").otherwise("heavy")


def hedge_words(clause: Column) -> Column:
    hits = F.array_sort(F.array_intersect(_words(clause), F.array(*[F.lit(w) for w in HEDGES])))
    return F.when(F.size(hits) > 0, F.array_join(hits, ", "))


def quote_type(clause: Column) -> Column:
    marks = F.length(clause) - F.length(F.replace(clause, F.lit('"'), F.lit("")))
    return F.when(marks >= 2, "direct").when(_any_of(F.lower(clause), INDIRECT), "indirect").otherwise("none")


def speech_act(clause: Column) -> Column:
    low = F.trim(F.lower(clause))
    opener = F.lit(False)
    for o in REQUEST_OPENERS:
        opener = opener | F.startswith(low, F.lit(o))
    request = opener | F.startswith(low, F.lit("please ")) | F.contains(F.substring(low, 1, 30), F.lit(" please "))
    return (
        F.when(request, "REQUEST")
        .when(F.endswith(F.rtrim(clause), F.lit("?")), "QUESTION")
        .when(F.endswith(F.rtrim(clause), F.lit("!")), "EXCLAMATION")
        .when(low.rlike(r"^(?:i|we)\s+(?:will|'ll|promise|swear|guarantee)\b"), "PROMISE")
        .when(_first_word(low).isin(COMMANDS), "COMMAND")
        .otherwise("INFORM")
    )


def conditional(clause: Column) -> Column:
    low = F.lower(clause)
    return (
        F.when(low.rlike(COUNTERFACTUAL), "counterfactual")
        .when(low.rlike(r"^\s*(?:suppose|imagine|assume)\b"), "hypothetical")
        .when(F.regexp_extract(low, "[a-z']+", 0).isin("if", "unless", "should"), "conditional")
    )


def hyperbole(clause: Column) -> Column:
    low = F.lower(clause)
    return F.when(_any_of(low, HYPERBOLES) | low.rlike(HYPERBOLE_NUMBERS), "hyperbolic_suspected")


def _surface(spokes: Column, roles: list[str]) -> Column:
    return F.try_element_at(F.filter(spokes, lambda s: s["role"].isin(roles)), F.lit(1))["surface"]


def scope(clause: Column, predicate: Column, spokes: Column) -> Column:
    """generic for a bare plural subject of a verb that is not in the past, else specific."""
    subject = F.lower(F.trim(F.coalesce(_surface(spokes, ["HAS_AGENT", "HAS_THEME", "HAS_EXPERIENCER"]), F.lit(""))))
    low, verb = F.lower(clause), F.lower(F.coalesce(predicate, F.lit("")))
    plural = subject.rlike("[^s]s$") & ~_first_word(subject).isin(DETERMINERS)
    past = _any_of(low, [" was ", " were "]) | F.endswith(verb, F.lit("ed")) | verb.isin(PAST_VERBS)
    return F.when(plural & ~past, "generic").otherwise("specific")


def negated_by_determiner(spokes: Column) -> Column:
    return F.exists(spokes, lambda s: s["role"].isin("HAS_AGENT", "HAS_PATIENT") & _first_word(F.coalesce(s["surface"], F.lit(""))).isin(NEGATIVE_DETERMINERS))


def modality_category(clause: Column) -> Column:
    low = F.lower(clause)
    return (
        F.when(_any_of(low, ["can ", "could ", "able to"]), "capability")
        .when(_any_of(low, ["must ", "have to", "obliged"]), "obligation")
        .when(_any_of(low, ["may ", "might ", "perhaps"]), "possibility")
        .when(_any_of(low, ["should ", "ought", "supposed to"]), "necessity")
    )


def point_of_view(clause: Column, predicate: Column, spokes: Column, reporting: list[str]) -> Column:
    """character, citation or author."""
    reports = F.coalesce(F.lower(predicate).isin(reporting), F.lit(False))
    quoted = (quote_type(clause) == "direct") | F.contains(clause, F.lit("''"))
    return F.when(reports & _surface(spokes, ["HAS_AGENT"]).isNotNull(), "character").when(reports | quoted, "citation").otherwise("author")


def statement_type(clause: Column, predicate: Column, spokes: Column, reporting: list[str]) -> Column:
    words, hedged, when_ = _words(clause), hedging(clause).isin("moderate", "heavy"), conditional(clause)
    rumoured = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ("believe", "claim", "rumor", "alleged", "reportedly")]))
    reported = (point_of_view(clause, predicate, spokes, reporting) != "author") | (hedged & rumoured)
    return (
        F.when(when_.isin("counterfactual", "hypothetical"), when_)
        .when(reported, "reported_claim")
        .when(hedged, "speculative")
        .when(when_ == "conditional", "conditional")
        .otherwise("proven_fact")
    )


def temporal_anchor(clause: Column, predicate: Column, spokes: Column) -> Column:
    relative = F.arrays_overlap(_words(clause), F.array(*[F.lit(w) for w in ("later", "yesterday", "tomorrow", "then", "recently")]))
    return F.when(clause.rlike(YEAR), "explicit_date").when(scope(clause, predicate, spokes) == "generic", "generic").when(relative, "relative")


def verb_modality(clause: Column) -> Column:
    words = _words(clause)
    some = lambda *w: F.arrays_overlap(words, F.array(*[F.lit(x) for x in w]))
    return F.when(some("must", "should"), "deontic").when(some("might", "may", "could"), "epistemic").otherwise("indicative")


def frame(clause: Column, predicate: Column, spokes: Column, polarity: Column, reporting: list[str]) -> Column:
    """The whole frame as a struct."""
    verb = F.lower(F.coalesce(predicate, F.lit("")))
    return F.struct(
        F.lit("straight").alias("rhetorical_mode"),
        hyperbole(clause).alias("rhetorical_mood"),
        hedging(clause).alias("hedging_level"),
        hedge_words(clause).alias("hedging_words"),
        point_of_view(clause, predicate, spokes, reporting).alias("point_of_view"),
        statement_type(clause, predicate, spokes, reporting).alias("statement_type"),
        quote_type(clause).alias("quote_type"),
        speech_act(clause).alias("speech_act"),
        scope(clause, predicate, spokes).alias("scope"),
        conditional(clause).alias("conditional_marker"),
        temporal_anchor(clause, predicate, spokes).alias("temporal_anchor"),
        F.when(F.endswith(verb, F.lit("ed")), "past").otherwise("present").alias("verb_tense"),
        F.when(F.endswith(verb, F.lit("ing")), "progressive").otherwise("simple").alias("verb_aspect"),
        F.when((F.coalesce(polarity, F.lit("positive")) == "positive") & F.coalesce(negated_by_determiner(spokes), F.lit(False)), "negative").otherwise(F.coalesce(polarity, F.lit("positive"))).alias("verb_polarity"),
        verb_modality(clause).alias("verb_modality"),
        modality_category(clause).alias("modality_category"),
    )


def epistemic_status(statement: Column) -> Column:
    return F.when(statement == "proven_fact", "ASSERTED").when(statement == "reported_claim", "REPORTED").when(statement == "speculative", "SPECULATIVE").when(statement.isin("hypothetical", "counterfactual", "conditional"), "HYPOTHETICAL").otherwise("CLAIMED")
