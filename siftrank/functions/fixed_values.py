"""Values that results depend on: templates, word lists and default parameters."""

# --- Fixed values: texts sent to models -------------------------------------
BGE_QUERY_PROMPT = "Represent this sentence for searching relevant passages: "

DEFAULT_QUERY_INSTRUCTION = (
    "Given a search query, retrieve relevant passages that answer the query."
)

RERANK_INSTRUCTION = (
    "Given a search query, retrieve relevant passages that answer the query"
)

ANNOTATION_SYSTEM_TEXT = (
    "You are a helpful assistant who helps accelerator physicists find useful information in technical documents. "
    "You will be given a question and some text. Decide whether the text helps answer the question. "
    "Always reply in exactly two lines:\n"
    "[ Guess ]: <Yes or No>\n"
    "[ Confidence ]: <0 - 100 >\n"
    "Never add any extra text."
)

ANNOTATION_PROMPT_TAIL = (
    "Is this paragraph helpful for answering the question? "
    "Note that the <paragraph> can be helpful even "
    "if it only addresses part of the question without fully answering it. "
    "Provide your best guess for this question and your confidence that the guess is correct. "
    "Reply in the following format:\n"
    "[ Guess ]: <Your most likely guess, should be one of 'Yes' or 'No'>\n"
    "[ Confidence ]: <Give your honest confidence score "
    "between 0 and 100 about the correctness of your guess. "
    "0 means very likely wrong, and 100 means very confident.>"
)

# --- Fixed values: what stands before the parts of a prompt ------------------
INSTRUCT_HEAD = "<Instruct>: "
QUERY_HEAD = "\n<Query>: "
DOCUMENT_HEAD = "\n<Document>: "
QUESTION_HEAD = "Question: "
PARAGRAPH_HEAD = "\nParagraph: "

# --- Fixed values: characters Python's str.strip and str.split treat as blank -
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PAIR_SEPARATOR = "\x1e"
BLAKE_BYTES = 12

# --- Fixed values: word lists and tags --------------------------------------
POSITIVE_WORDS = ("1", "true", "yes")
NEGATIVE_WORDS = ("0", "false", "no")
SOURCE_TAGS = ("IPAC", "expert")

# --- Fixed values: score columns in order of preference ----------------------
CURVE_SCORE_COLUMNS = ("rerank_score", "cos_score", "score")
FACET_SCORE_COLUMNS = ("rerank_score", "cos", "score")

# --- Fixed values: columns a training table must have ------------------------
TRAINING_COLUMNS = (
    "ID", "Name", "Question", "Question_type", "Expert_file", "Pages", "Specific_question?",
    "filename", "rank", "score", "chunk_text", "thought", "response", "Source", "label",
)

# --- Fixed values: default parameters ---------------------------------------
METRIC_KS = (3, 5, 10, 15, 20)
CHUNK_SIZE_CANDIDATES = (100, 150, 200, 250, 300)
CHUNK_MIN_TOKENS = 120
STORE_MIN_TOKENS = 200
RETRIEVAL_DEPTH = 40
CALLS_PER_MINUTE = 130
CALL_CONCURRENCY = 5
CALL_ATTEMPTS = 3
EMBED_ATTEMPTS = 5
RERANK_BATCH = 4
