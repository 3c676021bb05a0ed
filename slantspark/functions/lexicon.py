"""Word lists and suffix rules for the rule-based annotator (K2, K4, K6).

The reference calls a pre-trained English pipeline that is not available
offline; these lists are our own lexicon-and-rule approximation of it.  The
rules are plain data so the same definition compiles to a Spark Column (the
library) and to a DuckDB SQL expression (the oracle).
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Spark ML's default English stop-word list (StopWordsRemover, "english"),
# 181 words, in Spark's order.  tests/test_lexicon.py checks it equals
# StopWordsRemover.loadDefaultStopWords("english").
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can will just don should now "
    "i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're "
    "they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't "
    "won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
).split()

# Closed-class and frequent words with their Penn Treebank tag (lowercase forms).
TAG_WORDS = {
    "PRP": "i me you he him she her it we us they them myself yourself himself herself itself ourselves "
           "yourselves themselves one mine yours hers ours theirs",
    "PRP$": "my your his its our their",
    "WP": "who whom what whoever whatever",
    "WP$": "whose",
    "WDT": "which whichever",
    "WRB": "when where why how whenever wherever",
    "CC": "and or but nor yet plus either neither &",
    "DT": "the a an this that these those some any no every each all another both half",
    "PDT": "such",
    "EX": "there",
    "TO": "to",
    "MD": "can could may might must shall should will would",
    "IN": "of in for on with at by from about as into like through after over between out against during "
          "without before under around among than because if while although though since until whether upon "
          "within via per despite toward towards across behind beyond near above below unlike onto off",
    "VB": "be do have make go take get see come know give find tell think become leave put bring keep hold "
          "let mean set run pay meet lead read grow lose understand",
    "VBZ": "is has does says gets makes goes takes sees comes knows gives finds tells thinks seems means",
    "VBP": "are am have do say",
    "VBD": "was were had did said got made went took saw came knew gave found told thought became left felt "
           "brought began kept held wrote stood heard meant met ran paid sat spoke led grew lost fell sent "
           "built spent rose drove bought wore chose",
    "VBN": "been done gone taken seen known given shown written spoken chosen driven",
    "VBG": "being having doing going saying making getting",
    "RB": "not n't very also just now then here so too only even still already always never often "
          "sometimes again ever however almost perhaps quite rather soon later once well away back "
          "really instead maybe together yesterday today tomorrow further",
    "RBR": "more less",
    "RBS": "most least",
    "JJ": "good new first last long great little own other old right big high different small large next "
          "early young important few public bad same able many much several real sure free full true whole "
          "clear recent possible likely major political social national local federal economic human black "
          "white certain late hard best",
    "JJR": "better worse higher lower larger smaller greater older younger",
    "JJS": "worst highest lowest largest biggest greatest oldest",
}

# Suffix back-off for words not in TAG_WORDS, tried in this order.
SUFFIX_TAGS = [
    ("ly", "RB"),
    ("ing", "VBG"),
    ("ed", "VBD"),
    ("est", "JJS"),
    ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ical", "JJ"),
    ("less", "JJ"), ("ish", "JJ"), ("ic", "JJ"), ("al", "JJ"),
    ("tion", "NN"), ("sion", "NN"), ("ment", "NN"), ("ness", "NN"), ("ity", "NN"), ("ism", "NN"),
    ("ist", "NN"), ("ance", "NN"), ("ence", "NN"), ("ship", "NN"), ("hood", "NN"),
    ("ize", "VB"), ("ise", "VB"), ("ify", "VB"), ("ate", "VB"),
    ("ss", "NN"), ("us", "NN"), ("is", "NN"),
    ("s", "NNS"),
]

# Punctuation tags for single-character tokens.
PUNCT_TAGS = {".": ".", "!": ".", "?": ".", ",": ",", ":": ":", ";": ":", "-": "HYPH", "$": "$", "#": "#",
              "(": "-LRB-", ")": "-RRB-", '"': "''", "'": "''"}

# Single-token entity words (dates, quantities, places, groups), lowercase.
ENTITY_WORDS = (
    "january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday "
    "percent million billion trillion dollars dollar euros "
    "first second third fourth fifth sixth seventh eighth ninth tenth "
    "america american americans europe european china chinese russia russian iran iranian israel israeli "
    "mexico mexican canada canadian britain british england english france french germany german "
    "japan japanese india indian syria syrian iraq iraqi ukraine ukrainian "
    "texas california florida york washington ohio virginia michigan georgia arizona "
    "democrat democrats democratic republican republicans gop congress senate obama trump clinton"
).split()

# Currency and percent signs count as entity tokens.
ENTITY_SIGNS = ["$", "%", "€", "£"]
# Tag groups used by the features (F5-F10, F25, F26) and the noun-phrase classes (K5).
VERB_TAGS = ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"]
ADJ_TAGS = ["JJ", "JJR", "JJS"]
ADV_TAGS = ["RB", "RBR", "RBS"]
PRON_TAGS = ["PRP", "PRP$", "WP", "WP$"]
CONJ_TAGS = ["CC"]
NOUN_TAGS = ["NN", "NNS", "NNP", "NNPS"]
# Noun-phrase island classes: determiner-like, adjective, noun-like.
NP_DET_TAGS = ["DT", "PDT", "PRP$", "CD"]
NP_NOUN_TAGS = NOUN_TAGS + ["PRP"]
# --- end of fixed values ------------------------------------------------------


def tag_words() -> dict[str, list[str]]:
    """Tag -> word list, splitting the space-separated fixed strings."""
    return {tag: words.split() for tag, words in TAG_WORDS.items()}


def word_tag_pairs() -> list[tuple[str, str]]:
    """(word, tag) pairs; the first tag listed for a word wins."""
    seen: dict[str, str] = {}
    for tag, words in tag_words().items():
        for w in words:
            seen.setdefault(w, tag)
    return sorted(seen.items())
