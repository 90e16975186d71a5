"""Word tables written for this library: closed word classes, common verbs and adverbs, sentiment.

All are small (each under 200 words) and every function that uses one takes a replacement.
"""

from __future__ import annotations

# Closed word classes, by tag.
CLOSED_CLASS = {
    "DET": "the a an this these those each every either neither some any no all both such".split(),
    "PRON": (
        "i me my mine myself you your yours yourself he him his himself she her hers herself it its "
        "itself we us our ours ourselves they them their theirs themselves who whom whose which what "
        "someone anyone everyone something anything everything nothing nobody"
    ).split(),
    "ADP": (
        "of in on at by for with about against between into through during above below from up down "
        "over under among across behind beyond near within without toward towards upon per via"
    ).split(),
    "AUX": (
        "am is are was were be been being have has had having do does did can could will would shall "
        "should may might must"
    ).split(),
    "CCONJ": "and or but nor yet".split(),
    "SCONJ": (
        "because although though while if unless since whereas when whenever that until as whether "
        "after before once"
    ).split(),
    "PART": "not to n't".split(),
    "INTJ": "oh ah hey wow hello hi yes please ouch".split(),
    "NUM": "one two three four five six seven eight nine ten hundred thousand million".split(),
}

# Frequent open-class words that the suffix rules would miss.
COMMON_OPEN = {
    "ADV": (
        "very too also just still well fast soon often never always here there now then again almost "
        "already even far maybe perhaps quite rather so thus hence however therefore"
    ).split(),
    "VERB": (
        "say says said make makes made go goes went gone take takes took taken come comes came see sees "
        "saw seen know knows knew known get gets got give gives gave given find finds found think thinks "
        "thought tell tells told run runs ran keep keeps kept let lets show shows shown write writes wrote "
        "written become becomes became seem seems need needs want wants use uses"
    ).split(),
}

ADJ_SUFFIXES = ["ous", "ful", "ive", "able", "al", "less"]
VERB_SUFFIXES = ["ing", "ed", "ize", "ise"]

# Function words: the stop list, and the first part of the style vector.
FUNCTION_WORDS = sorted(
    {w for tag, ws in CLOSED_CLASS.items() if tag not in ("INTJ", "NUM") for w in ws}
    | {"very", "too", "also", "just", "still", "here", "there", "now", "then", "again", "so"}
)

# Sentiment: (polarity, subjectivity, words).
SENTIMENT = [
    (1.0, 1.0, "excellent wonderful awesome perfect superb magnificent delightful".split()),
    (0.8, 0.75, "great amazing brilliant fantastic lovely outstanding beautiful joyful".split()),
    (0.6, 0.7, "good happy fascinating enjoyable pleasant impressive elegant exciting".split()),
    (0.4, 0.5, "nice fine helpful useful interesting kind strong fresh clear bright".split()),
    (0.2, 0.4, "able new important easy fair real safe simple ready".split()),
    (-0.2, 0.4, "old slow long hard dry strange odd plain small".split()),
    (-0.4, 0.6, "weak poor dull boring tired difficult unclear rough".split()),
    (-0.6, 0.7, "bad sad angry ugly painful wrong unpleasant worthless".split()),
    (-0.8, 0.85, "hateful nasty dreadful disgusting miserable cruel".split()),
    (-1.0, 1.0, "terrible horrible awful worst detestable evil appalling".split()),
]
NEGATORS = "not no never n't cannot without hardly".split()
INTENSIFIERS = "very really extremely so too quite incredibly".split()
NEGATION_FACTOR = -0.5
INTENSITY_FACTOR = 1.3

# Default connector phrases; callers normally pass their own list.
CONNECTORS = [
    "and", "or", "so", "as", "if", "also", "but", "because", "however", "therefore", "moreover",
    "furthermore", "in addition", "for example", "for instance", "on the other hand", "as a result",
    "in contrast", "in conclusion", "although", "while", "since", "then", "finally", "first", "second",
]
