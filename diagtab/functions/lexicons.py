"""Word lists, kinds, arrows, labels.

They must equal the values the analysed data was produced with, so they are
stated plainly here and used by reference everywhere else.
"""

# Relationship kinds, in report order.
RELATIONSHIP_KINDS = (
    "association",
    "directed",
    "inheritance",
    "composition",
    "aggregation",
    "dependency",
    "association_class",
)

# Words that never name a class although they look like identifiers.
BLOCKED_NAMES = ("i.e", "e.g", "etc", "cf", "vs", "al", "viz", "approx", "yes", "no", "true", "false")

# Hedge words and modal verbs counted by the style features.
HEDGE_WORDS = (
    "may", "can", "could", "might", "would", "should", "typically", "often",
    "usually", "sometimes", "possibly", "perhaps", "probably", "likely",
)
MODAL_VERBS = ("can", "could", "may", "might", "must", "shall", "should", "will", "would")

# Verb lemmas per extraction rule.
ASSOCIATION_VERBS = ("take", "send", "buy", "give", "show", "record", "work", "talk")
AGGREGATION_VERBS = (
    "hold", "carry", "involve", "imply", "embrace",
    "consist", "comprise", "belong", "divide", "include",
)
COMPOSITION_VERBS = ("have", "comprise", "possess", "contain")

# The preposition an aggregation verb accepts; other verbs accept none.
AGGREGATION_PREPOSITIONS = {
    "consist": "of", "comprise": "of", "belong": "to", "divide": "to", "include": "in",
}

# Names that a generalization never links.
GENERALIZATION_RESERVED = ("category", "type", "kind", "a")

# Canonical arrow per relationship kind.
ARROW_OF_KIND = {
    "association": "--",
    "directed": "-->",
    "inheritance": "<|--",
    "composition": "*--",
    "aggregation": "o--",
    "dependency": "..",
    "association_class": "..",
}

# Score buckets, left-closed; the last one also takes 1.0.
BUCKET_UPPER_BOUNDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0001)
BUCKET_LABELS = (
    "[0, 0.1)", "[0.1, 0.2)", "[0.2, 0.3)", "[0.3, 0.4)", "[0.4, 0.5)",
    "[0.5, 0.6)", "[0.6, 0.7)", "[0.7, 0.8)", "[0.8, 0.9)", "[0.9, 1.0]",
)

# The three scored elements.
SCORE_ELEMENTS = ("class_score", "attribute_score", "association_score")

# Job states in report order.
JOB_STATES = ("done", "in_progress", "pending", "failed", "cancelled")
