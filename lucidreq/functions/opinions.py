"""Opinion words with their subjectivity, and what raises, lowers or ends it in their context."""

#: Words and phrases (their words joined by an underscore) and how subjective they are, between 0 and 1.
WEIGHTS = {
    "as_possible": 0.6, "attractive": 0.9, "awful": 1.0, "bad": 0.7, "beautiful": 1.0, "best": 0.6, "better": 0.5, "big": 0.4,
    "clean": 0.5, "clear": 0.4, "clever": 0.8, "comfortable": 0.8, "convenient": 0.7, "easily": 0.7, "easy": 0.7, "efficient": 0.5,
    "elegant": 0.9, "excellent": 1.0, "fast": 0.6, "flexible": 0.5, "friendly": 0.7, "good": 0.6, "great": 0.8, "having_in_mind": 0.5,
    "helpful": 0.7, "important": 0.6, "interesting": 0.8, "intuitive": 0.8, "large": 0.4, "modern": 0.5, "nice": 0.9, "obvious": 0.6,
    "perfect": 1.0, "pleasant": 0.9, "poor": 0.7, "powerful": 0.7, "proper": 0.4, "quick": 0.6, "quickly": 0.6, "reasonable": 0.6,
    "robust": 0.4, "significant": 0.6, "similar": 0.4, "similarly": 0.4, "simple": 0.5, "slow": 0.5, "small": 0.4, "smart": 0.7,
    "strong": 0.5, "sufficient": 0.5, "suitable": 0.5, "take_into_account": 0.5, "take_into_consideration": 0.5, "terrible": 1.0,
    "ugly": 1.0, "useful": 0.6, "weak": 0.5, "wonderful": 1.0, "worse": 0.6, "worst": 0.8,
}
#: Words that multiply the subjectivity of the opinion after them.
DEGREES = {
    "absolutely": 1.4, "barely": 0.6, "extremely": 1.5, "fairly": 0.9, "highly": 1.3, "incredibly": 1.5, "more": 1.1, "most": 1.2,
    "particularly": 1.2, "partly": 0.7, "quite": 1.1, "rather": 0.9, "really": 1.3, "slightly": 0.6, "so": 1.2, "somewhat": 0.7,
    "too": 1.2, "totally": 1.4, "truly": 1.3, "very": 1.3,
}
NEGATIONS = ["cannot", "neither", "never", "no", "nor", "not", "without"]
NEGATED_END = "n't"
#: What ends the scope of a negation or degree.
BREAKS = [".", "!", "?", ";", ":", ",", "but", "although", "though", "however", "while"]
#: A negated opinion counts by this share.
NEGATED = 0.5
#: Tokens before an opinion that are its context.
SCOPE = 3
