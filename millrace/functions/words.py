"""Word lists and tables that results depend on."""

# Contractions and slang, expanded as whole tokens.
CONTRACTIONS = {
    "ain't": "am not", "aren't": "are not", "can't": "cannot", "can't've": "cannot have", "'cause": "because",
    "could've": "could have", "couldn't": "could not", "couldn't've": "could not have", "didn't": "did not",
    "doesn't": "does not", "don't": "do not", "hadn't": "had not", "hadn't've": "had not have", "hasn't": "has not",
    "haven't": "have not", "he'd": "he would", "he'd've": "he would have", "he'll": "he will", "he's": "he is",
    "how'd": "how did", "how'll": "how will", "how's": "how is", "i'd": "i would", "i'll": "i will", "i'm": "i am",
    "i've": "i have", "isn't": "is not", "it'd": "it would", "it'll": "it will", "it's": "it is", "let's": "let us",
    "ma'am": "madam", "mayn't": "may not", "might've": "might have", "mightn't": "might not", "must've": "must have",
    "mustn't": "must not", "needn't": "need not", "oughtn't": "ought not", "shan't": "shall not", "sha'n't": "shall not",
    "she'd": "she would", "she'll": "she will", "she's": "she is", "should've": "should have", "shouldn't": "should not",
    "that'd": "that would", "that's": "that is", "there'd": "there had", "there's": "there is", "they'd": "they would",
    "they'll": "they will", "they're": "they are", "they've": "they have", "wasn't": "was not", "we'd": "we would",
    "we'll": "we will", "we're": "we are", "we've": "we have", "weren't": "were not", "what'll": "what will",
    "what're": "what are", "what's": "what is", "what've": "what have", "where'd": "where did", "where's": "where is",
    "who'll": "who will", "who's": "who is", "won't": "will not", "wouldn't": "would not", "you'd": "you would",
    "you'll": "you will", "you're": "you are", "wfh": "work from home", "wfo": "work from office", "idk": "i do not know",
    "brb": "be right back", "btw": "by the way", "tbh": "to be honest", "omw": "on my way", "lmk": "let me know",
    "fyi": "for your information", "imo": "in my opinion", "smh": "shaking my head", "nvm": "never mind",
    "ikr": "i know right", "fr": "for real", "rn": "right now", "gg": "good game", "dm": "direct message",
    "afaik": "as far as i know", "bff": "best friends forever", "ftw": "for the win", "hmu": "hit me up",
    "ggwp": "good game well played",
}

# Common English function words that text cleaning removes.
STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most other some such
no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't
mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Texts that stand for a missing value, compared trimmed and lower-cased.
MISSING = [
    "na", "n/a", "n.a.", "null", "none", "nan", "nil", "-", "--", "?", "??", "unknown", "unk", "missing", "not available",
    "not applicable", "", " ",
]

# Texts that stand for booleans, compared trimmed and lower-cased.
TRUE_WORDS = ["true", "t", "yes", "y", "1", "on"]
FALSE_WORDS = ["false", "f", "no", "n", "0", "off"]

# Formats by kind.
FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^https?://[^\s]+$",
    "ip": r"^(\d{1,3}\.){3}\d{1,3}$",
    "phone": r"^\+?[\d\s\-().]{7,}$",
    "postal": r"^[A-Za-z0-9][A-Za-z0-9\s\-]{2,9}$",
}

# Country names by lower-case alias.
COUNTRIES = {
    "usa": "United States", "us": "United States", "u.s.a.": "United States", "united states of america": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "england": "United Kingdom", "uae": "United Arab Emirates",
    "india": "India", "in": "India", "bharat": "India",
}
