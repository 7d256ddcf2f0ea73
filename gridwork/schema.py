"""Fixed schemas of the engine.

``slots`` is the core table: one row per grid position of every keyed table
(long format). ``text`` NULL marks an unfilled slot, ``''`` an empty cell;
``src_ord`` identifies the source cell a spanned slot was copied from.
``page_id`` is the report file: ``table_ord`` counts inside it and the unit
carry-over stays in it; tables are keyed by ``TABLE_KEY`` (of a table id that
several files of a document have, the last file's table is kept).
"""

SLOTS = (
    "doc_id string, page_id string, table_id string, table_ord bigint, r int, c int, "
    "src_ord int, cell_id string, text string, type array<double>"
)
SLOT_COLS = ["doc_id", "page_id", "table_id", "table_ord", "r", "c", "src_ord", "cell_id", "text", "type"]
TABLE_KEY = ["doc_id", "table_id"]

SENTENCES = (
    "doc_id string, table_id string, r int, c int, sentence string, cell_id string, data string"
)
SPLITS = "doc_id string, table_id string, variant string, row_split int, col_split int"
GOLD = "doc_id string, table_id string, is_include boolean, row_split int, col_split int"
QUESTIONS = "qid string, question string, doc_id string, table_id string, cell_id string"
PAIRS = "label int, question string, sentence string"
NLI = "label string, s1 string, s2 string"

# Class indexes of the cell classifier (fixed values).
CLASS_NAMES = ["metadata", "header", "attribute", "data"]
DATA_CLASS = 3
