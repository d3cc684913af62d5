"""Word classes used by predicates and features. All are plain data; every function that uses one takes it as a
parameter with these as defaults."""

# Closed-class words that stand in for tags where text has none.
CLOSED_CLASS = ["the", "of", "and", "in", "by", "for", "is", "with", "to", "are", "was", "on", "or", "as", "at", "that", "it", "an", "be", "from", "this", "not", "you", "have", ","]

# Pronouns by person and number, and demonstratives.
PRONOUNS = {
    "first_singular": ["i", "me", "my", "mine", "myself"],
    "second": ["you", "your", "yours", "yourself", "yourselves"],
    "third_male": ["he", "him", "his", "himself"],
    "third_female": ["she", "her", "hers", "herself"],
    "third_neuter": ["it", "its", "itself"],
    "first_plural": ["we", "us", "our", "ours", "ourselves"],
    "third_plural": ["they", "them", "their", "theirs", "themselves"],
    "demonstrative": ["this", "that", "these", "those"],
    "relative": ["who", "whom", "whose", "which"],
}
ALL_PRONOUNS = sorted({w for ws in PRONOUNS.values() for w in ws})

# Heads that no anaphor has.
PRONOUN_HEADS = [
    "myself", "ourselves", "yourself", "yourselves", "himself", "herself", "itself", "mine", "ours", "yours", "his", "hers", "theirs", "that", "which", "who", "whom", "whose", "i", "me", "she", "he", "her",
    "him", "it", "this", "we", "us", "they", "them", "these", "themselves", "our", "my", "your",
]
# Heads of further noun phrases that count as pronouns.
INDEFINITE_PRONOUNS = [
    "all", "another", "any", "anybody", "anyone", "anything", "both", "each", "either", "everybody", "everyone", "everything", "few", "little", "many", "more", "much", "most", "nobody", "none", "nothing",
    "neither", "one", "other", "others", "some", "somebody", "something", "someone", "those",
]
# Words that compare with something said before.
COMPARATIVES = ["other", "another", "such", "different", "similar", "additional", "comparable", "same", "further", "extra"]
# Determiners and possessives.
DEFINITE = ["the", "that", "this", "those", "these", "one"]
DEFINITE_ARTICLE = ["the"]
INDEFINITE_FIRST = ["a", "an", "some"]
INDEFINITE = ["a", "an", "one", "some", "any", "either", "neither", "no", "all", "each", "every", "another", "whichever", "which", "what", "whatever"]
DEMONSTRATIVES = ["that", "this", "those", "these"]
POSSESSIVE_PRONOUNS = ["my", "your", "his", "her", "our", "their", "its"]
POSSESSIVES = ["'s", "s'"]
QUANTIFIERS = ["all", "no", "neither", "every", "any", "most"]
# Numbers, those of pairs first.
SMALL_NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
NUMBERS = [*SMALL_NUMBERS, "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundreds", "thousands", "millions"]
# Heads that are elements of a set, beside the indefinite determiners and numbers.
SET_ELEMENTS = ["one", "some", "none", "many", "most"]
# Modifiers of place and time; the first two begin with the ligature U+FB01.
SPATIAL_TEMPORAL = [
    "\ufb01nal", "\ufb01rst", "last", "next", "prior", "succeed", "second", "nearby", "previous", "close", "above", "adjacent", "behind", "below", "bottom", "early", "formal", "future", "before", "after",
    "earlier", "later",
]
# Tokens of speech and markup that are no nouns to learn from, case as written.
USELESS_WORDS = [
    "lot", "sort", "kind", "um", "huh", "yeah", "]", "[", "/", "i", "things", "right", "yep", "something", "thing", "anything", "stuff", "CD", "hm", "hmm", "p", "P", "ras", "<", ">", "C", "c", "tm", "Trp", "th",
    "",
]
# Penn tags.
NOUN_TAGS = ["NN", "NNS", "NNP", "NNPS", "PRP", "PRP$"]
#: Beginnings of tags of words that some patterns pass over; those that end in $ are whole tags.
GAP_TAGS = ["DT$", "J", "CD$", "PRP"]
CONTENT_TAGS = ["NN", "NNS", "NNP", "NNPS", "JJ"]
