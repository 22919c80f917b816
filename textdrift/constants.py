"""Fixed values of the data model.

Everything in this module is a fixed value that results depend on: dataset names, rewriter
names and families, stage labels, tag sets, feature names and the English stopword list.
"""

# ---------------------------------------------------------------------------------------------
# Fixed values (must stay exactly as written)
# ---------------------------------------------------------------------------------------------

DATASETS = ["sci_gen", "wp", "xsum", "eli5", "cmv", "tldr", "yelp"]
WORKING_DATASETS = ["sci_gen", "wp", "xsum"]

REQUIRED_COLUMNS = ["source", "key", "text", "version_name"]

STAGES = ["T0", "T1", "T2", "T3"]
LATER_STAGES = ["T1", "T2", "T3"]

FAMILIES = {
    "pegasus": ["pegasus(full)", "pegasus(slight)"],
    "dipper": ["dipper(high)", "dipper", "dipper(low)"],
    "palm": ["palm"],
    "chatgpt": ["chatgpt"],
}

ORIGINAL = "original"

# tag set of the style features: 16 tags, no AUX and no PROPN, legacy CONJ kept
TRACKED_POS = [
    "NOUN", "VERB", "ADJ", "ADV", "PRON", "DET",
    "ADP", "CONJ", "CCONJ", "SCONJ", "NUM", "PART",
    "INTJ", "PUNCT", "SYM", "X",
]

# tag set of the Human-vs-LLM comparison: 17 universal tags in alphabetical order
UPOS_TAGS = [
    "ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN",
    "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X",
]

# tag subset of the heatmap and of the JS drift
MAIN_POS = ["NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "PUNCT"]

SCALAR_FEATURES = ["sent_len_mean", "sent_len_var", "ttr", "punct_ratio",
                   "dep_depth_mean", "dep_depth_max"]

METRIC_LABELS = {"bleu": "BLEU-2", "rouge1": "ROUGE-1", "rouge2": "ROUGE-2", "rougeL": "ROUGE-L"}

# the six rewriters of the Human-vs-LLM bar chart
KEY_PARAPHRASERS = ["chatgpt", "dipper(high)", "dipper(low)", "pegasus(slight)", "pegasus(full)", "palm"]

# low/high intensity variants compared per family
INTENSITY_VARIANTS = [
    ("pegasus", "pegasus(slight)", "low"),
    ("pegasus", "pegasus(full)", "high"),
    ("dipper", "dipper(low)", "low"),
    ("dipper", "dipper(high)", "high"),
]

# accuracy at or below which a stage counts as "identity lost"
NO_RETURN_THRESHOLD = 0.55

# ASCII punctuation (the 32 characters of Python's string.punctuation)

# English stopwords (the common 179-word list)
STOPWORDS_EN = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]
