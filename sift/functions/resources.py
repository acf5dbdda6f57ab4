"""Fixed word lists and constants.

Every list here is data, not logic.  The stop-word list is Spark's public
English list (``StopWordsRemover.loadDefaultStopWords('english')``) written
out so that the DuckDB oracle can embed exactly the same words.  The
contraction, abbreviation, lexicon and seed-word tables are our own small
lists; users pass their own tables for production vocabularies.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# The 32 ASCII punctuation characters (Python's string.punctuation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Spark's default English stop words, in Spark's order (181 words).
STOP_WORDS = [
    'i', 'me', 'my', 'myself', 'we', 'our', 'ours', 'ourselves', 'you', 'your',
    'yours', 'yourself', 'yourselves', 'he', 'him', 'his', 'himself', 'she', 'her', 'hers',
    'herself', 'it', 'its', 'itself', 'they', 'them', 'their', 'theirs', 'themselves', 'what',
    'which', 'who', 'whom', 'this', 'that', 'these', 'those', 'am', 'is', 'are',
    'was', 'were', 'be', 'been', 'being', 'have', 'has', 'had', 'having', 'do',
    'does', 'did', 'doing', 'a', 'an', 'the', 'and', 'but', 'if', 'or',
    'because', 'as', 'until', 'while', 'of', 'at', 'by', 'for', 'with', 'about',
    'against', 'between', 'into', 'through', 'during', 'before', 'after', 'above', 'below', 'to',
    'from', 'up', 'down', 'in', 'out', 'on', 'off', 'over', 'under', 'again',
    'further', 'then', 'once', 'here', 'there', 'when', 'where', 'why', 'how', 'all',
    'any', 'both', 'each', 'few', 'more', 'most', 'other', 'some', 'such', 'no',
    'nor', 'not', 'only', 'own', 'same', 'so', 'than', 'too', 'very', 's',
    't', 'can', 'will', 'just', 'don', 'should', 'now', "i'll", "you'll", "he'll",
    "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm",
    "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've", "you've", "they've",
    "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", 'cannot', 'could', "here's",
    "how's", "let's", 'ought', "that's", "there's", "what's", "when's", "where's", "who's", "why's",
    'would',
]

# Contractions -> expansion (lowercase keys; applied to whole tokens only).
CONTRACTIONS = {
    "aren't": "are not", "can't": "cannot", "couldn't": "could not",
    "didn't": "did not", "doesn't": "does not", "don't": "do not",
    "hadn't": "had not", "hasn't": "has not", "haven't": "have not",
    "he's": "he is", "i'd": "i would", "i'll": "i will", "i'm": "i am",
    "i've": "i have", "isn't": "is not", "it's": "it is", "let's": "let us",
    "mustn't": "must not", "shouldn't": "should not", "that's": "that is",
    "there's": "there is", "they're": "they are", "they've": "they have",
    "wasn't": "was not", "we're": "we are", "we've": "we have",
    "weren't": "were not", "what's": "what is", "won't": "will not",
    "wouldn't": "would not", "you're": "you are", "you've": "you have",
}

# Chat abbreviations -> expansion (lowercase keys; whole tokens only).
ABBREVIATIONS = {
    "asap": "as soon as possible", "b4": "before", "btw": "by the way",
    "fyi": "for your information", "gr8": "great", "idk": "i do not know",
    "imo": "in my opinion", "lol": "laughing out loud", "msg": "message",
    "pls": "please", "plz": "please", "r": "are", "thx": "thanks",
    "u": "you", "ur": "your", "w/": "with", "w/o": "without",
}

# Small English sentiment lexicon (word, score in [-1, 1]); file order matters:
# the first row of a word wins.
LEXICON = [
    ("good", 0.6), ("great", 0.8), ("excellent", 0.9), ("happy", 0.7),
    ("helpful", 0.5), ("friendly", 0.5), ("love", 0.8), ("well", 0.3),
    ("better", 0.4), ("best", 0.8), ("nice", 0.5), ("support", 0.2),
    ("bad", -0.6), ("poor", -0.6), ("terrible", -0.9), ("awful", -0.9),
    ("slow", -0.4), ("problem", -0.4), ("difficult", -0.5), ("hate", -0.8),
    ("worse", -0.6), ("worst", -0.9), ("lack", -0.4), ("unclear", -0.4),
    ("neutral", 0.0), ("ok", 0.0),
]

# Seed words for the comment predicate (positive / negative answers).
POSITIVE_SEEDS = ["good", "great", "helpful", "flexible", "friendly", "support"]
NEGATIVE_SEEDS = ["bad", "slow", "lack", "poor", "unclear", "workload"]

# Words of the driver's synthetic corpus with scores of both signs, one of them twice
# (the first row counts), and seed words that occur in it.
CORPUS_LEXICON = [
    ("with", 0.1), ("are", 0.05), ("idiot", -0.8), ("moron", -0.9), ("stupid", -0.7), ("worthless", -0.7),
    ("pathetic", -0.6), ("scum", -0.9), ("clown", -0.3), ("clown", -0.9), ("that", 0.0),
]
CORPUS_POSITIVE_SEEDS = ["for", "good"]
CORPUS_NEGATIVE_SEEDS = ["idiot", "moron", "stupid", "bad"]

# English plural-to-singular suffix rules for the rule lemmatiser, applied in
# this order to tokens longer than 3 characters: (suffix, replacement).
PLURAL_RULES = [
    ("sses", "ss"), ("ies", "y"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("s", ""),
]
# Suffixes that block the bare "s" rule.
PLURAL_KEEP = ["ss", "us", "is"]
# --- end of fixed values ----------------------------------------------------
