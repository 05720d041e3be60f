"""English words left out of text search, and endings that are taken off."""

# The usual English stop words of text search.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until while of at by for with
    about against between into through during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now
    """.split()
)

#: Endings in the order in which they are taken off: plurals, verb forms, derived nouns and adjectives, last letters. What is
#: left of a word by the second and third group has a vowel. Patterns mean the same to Java and RE2.
STEM_RULES = (
    (r"^(.+)sses$", "$1ss"),
    (r"^(..+)(?:ies|ied)$", "$1y"),
    (r"^(.+(?:x|ch|sh|zz))es$", "$1"),
    (r"^(.*[^suia])s$", "$1"),
    (r"^([^aeiouy]*[aeiouy].*[a-z])(?:ingly|edly|ing|ed|ly)$", "$1"),
    (r"^(.*)(?:(b)b|(d)d|(f)f|(g)g|(m)m)$", "$1$2$3$4$5$6"),
    (r"^(.*)(?:(n)n|(p)p|(r)r|(t)t)$", "$1$2$3$4$5"),
    (r"^(.*[aeiouy].+)(?:ational|ation|ator|ative|ate|at)$", "$1"),
    (r"^(.*[aeiouy].+)(?:ment|ness|able|ible|ance|ence|ity|ful|ive|ion|al)$", "$1"),
    (r"^(..+)e$", "$1"),
    (r"^(..*[^aeiou])y$", "$1i"),
)

_LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: The rules in steps: how many there are, and the last two letters of the words that one of them can change.
STEM_STEPS = (
    (4, (*(f"{c}s" for c in _LETTERS), "ed")),
    (1, ("ly", "ng", "ed")),
    (2, ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")),
    (2, ("al", "on", "or", "ve", "te", "at", "nt", "ss", "le", "ce", "ty", "ul")),
    (2, tuple(f"{c}{end}" for c in _LETTERS for end in "ey")),
)
