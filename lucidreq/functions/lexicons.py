"""The phrase lists of the smell rules, and the rules' headers.

The lists must equal the published rules' for the same findings.
"""

AMBIGUOUS = ["may", "could", "has to", "have to", "might", "will", "should have", "must have", "all the other", "all other", "based on", "some", "appropriate", "as a", "as an", "a minimum", "up to", "adequate", "as applicable", "be able to", "be capable", "but not limited to", "capability of", "capability to", "effective", "normal"]
REQUIREMENT = ["shall", "must", "should", "will", "requires", "necessitates", "needs to", "is required to"]
SECURITY = ["security", "secure", "confidentiality", "integrity", "availability", "authentication", "authorization", "encryption", "access control", "audit", "firewall", "intrusion detection", "vulnerability", "patching", "secure communication", "privacy", "compliance", "risk assessment", "incident response", "disaster recovery", "secure coding"]
OPTIONALITY = ["can", "may", "optionally"]
CONJUNCTION = ["and", "after", "although", "as long as", "before", "but", "else", "if", "in order", "in case", "nor", "or", "otherwise", "once", "since", "then", "though", "till", "unless", "until", "when", "whenever", "where", "whereas", "wherever", "while", "yet"]
CONTINUANCES = ["below", "as follows", "following", "listed", "in particular", "support", "and", ":"]
IMPERATIVES = ["must", "should", "could", "would", "can", "will", "may", "shall", "is required to", "are applicable", "are to", "responsible for"]
VAGUENESS = AMBIGUOUS
REFERENCES = ["e.g.", "i.e.", "for example", "for instance", "figure", "table", "note"]
SUBJECTIVITY = ["similar", "better", "similarly", "worse", "having in mind", "take into account", "take into consideration", "as possible", "good", "smart", "clever"]
WEAKNESS = ["adequate", "as appropriate", "be able to", "be capable of", "capability", "effective", "as required", "normal", "provide for", "timely", "easy to"]

LOW_READABILITY_BELOW = 30.0
SUBJECTIVITY_ABOVE = 0.5

#: Header of each counting rule, in the order of the report.
COUNTERS = {
    "Optionality": OPTIONALITY,
    "Conjunction": CONJUNCTION,
    "Continuances": CONTINUANCES,
    "Imperatives": IMPERATIVES,
    "Weakness": WEAKNESS,
    "Vagueness": VAGUENESS,
    "Subjectivity": SUBJECTIVITY,
    "References": REFERENCES,
}
SMELLS = ["Ambiguity Detected", "Low Readability", "Subjectivity Detected", "Security Related", "Not a Requirement"]
NEGATIVE = ["Not a Requirement", "Low Readability", "Ambiguity Detected", "Vagueness", "Subjectivity Detected", "Subjectivity", "Weakness", "Optionality"]
EXCLUDED = ["Conjunction", "Continuances", "Imperatives", "References"]
