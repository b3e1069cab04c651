"""Default parameters.

Values marked FIXED must equal the behaviour being reproduced; everything else
is a tunable default.  All lists are plain parameters of the operators that use
them, so a caller can pass another list.
"""

# ---------------------------------------------------------------- FIXED values
# Thresholds: sentence match (check service), paper dense/LDA match, pair minimum.
MATCH_THRESHOLD = 0.9
PAPER_THRESHOLD = 0.8
PAIR_MIN_PERCENT = 20.0
# Hits per query of the top-k search.
SEARCH_TOP_K = 5
# Vector index shape: number of cells and cells probed.
IVF_NLIST = 1024
IVF_NPROBE_SEARCH = 16
IVF_TRAIN_ROWS = 100_000       # vectors that train the cells, at most
IVF_CELL_ROWS = 2              # vectors a cell of the registered searches, until IVF_NLIST cells are reached
IVF_PROBED_SHARE = 4           # one in so many cells is probed by the registered searches
# Minimum words in a kept sentence (fewer are excluded), chunk size in subtokens.
MIN_SENTENCE_WORDS = 10
PAPER_MIN_PIECES = 6          # keep sentences with more than this many pieces
CHUNK_MAX_SUBTOKENS = 450
NOISE_MIN_PIECES = 15         # noise filters keep more than this many pieces
# Report defaults: A4 page size, number of reported documents, palette size.
PAGE_WIDTH = 595.0
PAGE_HEIGHT = 842.0
TOP_DOCUMENTS = 5
# Rectangle merge tolerances: production (y0 distance) and paper (y1 gap).
RECT_Y0_TOLERANCE = 5.0
RECT_Y1_GAP = 2.0
# Evaluation: parts per sentence list, copy shares, mean sentences per document.
SPLIT_PARTS = 10
EVAL_SHARES = (30, 60, 90)
EVAL_AVG_SENTENCES = 400
# Score bands (upper bounds, inclusive).
SCORE_BANDS = (30, 60, 90)
# Stop-word list size of the LDA path.
STOPWORDS_LDA = 40
# Word2Vec / LDA shape.
W2V_SIZE = 100
W2V_WINDOW = 5
W2V_MIN_COUNT = 1
LDA_TOPICS = 20
LDA_PASSES = 15
LDA_ROUNDS = 20                # fixed-point rounds of a document in a pass
LDA_BLOCK_ROWS = 200_000       # (document, token) entries a block of the fit
W2V_EPOCHS = 5
W2V_PARTITIONS = 8             # fixed, so that the model does not change with the cluster

# FIXED: substrings that mark a boilerplate sentence (in this order).
BOILERPLATE_PATTERNS = [
    "CHƯƠNG", "Hình", "Bảng", "Use Case", "    ",
    "em", "Em", "cảm ơn", "Th.S", "ThS", "TS", "Thầy", "thầy", "Cô",
]

# FIXED: strict noise blacklist for fresh sentences (36 substrings, in order).
NOISE_STRICT = [
    "..", "\n \n", "•", "*", "−", "\uf0b7", "➢", ":", "+", "_", "𝑓", "❖", "-",
    "o", "a)", "[", "]", "(", ")", "▪", "<", "%", "“", "”", "?", "Th.S", "ThS",
    "TS", "Thầy", "Cô", "thầy", "cô", "cảm ơn", "\uf02d", "–", "    ",
]
# FIXED: the seed filter uses the same list without "]".
NOISE_SEEDS = [p for p in NOISE_STRICT if p != "]"]
# FIXED: loose blacklist for sentences already in the corpus.
NOISE_LOOSE = ["..", "\n \n", "𝑓"]

# Whitespace as Python's str.split / re \s sees it, listed explicitly so that the
# JVM (java.util.regex) and RE2 (DuckDB) read the same class.
WS_CLASS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Characters kept by the word tokenizer (letters, marks, digits, underscore, space).
NON_WORD_CLASS = r"[^\p{L}\p{M}\p{N}_ ]"
# Section numbers 1. .. 99. at the start of a sentence.
SECTION_NUMBER_RE = r"^[1-9][0-9]?\."
# Sentence boundary: terminal punctuation followed by a space (text already cleaned).
SENTENCE_END_RE = r"([.!?]) "
SENTENCE_SEP = "\u0001"

# Hashed-token encoder: dimension of the native default sentence vector.
HASH_DIM = 256

# Sizing guards.
BROADCAST_GUARD_BYTES = 64 * 1024 * 1024      # largest query matrix we broadcast
BLOCK_TARGET_BYTES = 32 * 1024 * 1024         # vectors per block in blocked kernels
