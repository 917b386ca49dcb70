"""Fixed values of the text formats, word lists and patterns.

Everything here is a contract: the strings must stay as they are for results to be right.
"""

# Words that are never reported as unknown identifiers.
RESERVED_WORDS = (
    "select", "from", "where", "join", "left", "right", "inner", "outer", "full", "on", "and", "or",
    "not", "as", "with", "group", "by", "order", "asc", "desc", "limit", "offset", "case", "when",
    "then", "else", "end", "null", "is", "in", "between", "like", "ilike", "exists", "distinct",
    "union", "intersect", "except", "all", "any", "some", "having", "cast", "true", "false",
    "lateral", "using", "count", "sum", "avg", "min", "max", "coalesce", "nullif", "greatest",
    "least", "round", "floor", "ceil", "ceiling", "abs", "mod", "power", "sqrt", "sign", "length",
    "char_length", "octet_length", "lower", "upper", "initcap", "substring", "substr", "concat",
    "concat_ws", "trim", "ltrim", "rtrim", "replace", "translate", "split_part", "regexp_replace",
    "regexp_match", "position", "to_char", "to_date", "to_timestamp", "to_number", "date_trunc",
    "date_part", "extract", "now", "current_date", "current_time", "current_timestamp", "localtime",
    "localtimestamp", "interval", "age", "epoch", "numeric", "decimal", "int", "int2", "int4",
    "int8", "bigint", "integer", "smallint", "text", "varchar", "char", "character", "date",
    "timestamp", "timestamptz", "time", "boolean", "bool", "real", "double", "precision", "float",
    "json", "jsonb", "uuid", "over", "partition", "row_number", "rank", "dense_rank", "lag", "lead",
    "first_value", "last_value", "ntile", "percent_rank", "cume_dist", "nulls", "first", "last",
    "array", "array_agg", "string_agg", "unnest", "window", "within", "rows", "range", "preceding",
    "following", "unbounded", "current", "returning", "collate", "similar", "tsvector", "tsquery",
)

# Words that cannot be a table alias.
NON_ALIAS_WORDS = (
    "where", "on", "group", "order", "having", "left", "right", "inner", "outer", "full", "cross",
    "lateral", "using", "limit", "offset", "as", "union", "intersect", "except", "join", "with",
    "select", "and", "or", "not",
)

# Write patterns, in the order in which they are tried.
WRITE_PATTERNS = (
    r"\bINTO\s+OUTFILE\b",
    r"\bINTO\s+DUMPFILE\b",
    r"\bLOAD_FILE\b",
    r"\bINSERT\s+INTO\b",
    r"\bUPDATE\s+\w+\s+SET\b",
    r"\bDELETE\s+FROM\b",
    r"\bDROP\s+(TABLE|DATABASE|SCHEMA|INDEX)\b",
    r"\bALTER\s+(TABLE|DATABASE)\b",
    r"\bCREATE\s+(TABLE|DATABASE|SCHEMA|INDEX)\b",
    r"\bTRUNCATE\b",
    r"\bGRANT\b",
    r"\bREVOKE\b",
    r"\bEXEC(UTE)?\b",
    r"\bCALL\b",
)

# Patterns over SQL texts, in Java form (names, aliases, dotted and bare words, WITH names, AS names).
SQL_REF = r"(?i)(?U)\b(?:FROM|JOIN)\s+([\w.]+)"
SQL_REF_ALIAS = r"(?i)(?U)\b(?:FROM|JOIN)\s+([\w.]+)(?:\s+(?:AS\s+)?(\w+))?"
SQL_DOTTED = r"(?U)\b(\w+)\.(\w+)\b"
SQL_BARE = r"(?U)\b([a-zA-Z_][a-zA-Z_0-9]*)\b"
SQL_CTE = r"(?i)(?U)\b(\w+)\s+AS\s*\("
SQL_AS = r"(?i)(?U)\bAS\s+(\w+)"

# Exclusion set of the catalog extraction.
EXCLUDED_SCHEMAS = ("information_schema", "pg_catalog", "knowledge", "hg_recyclebin")
EXCLUDED_SCHEMA_LIKE = ("pg_%",)
EXCLUDED_TABLE_LIKE = ("%_middle%",)
TABLE_KINDS = ("r", "p", "v", "m")

# Headings and texts of the cards, hints and examples.
CARD_HEADER = "表名: "
CARD_COMMENT = " 表注释: "
CARD_COLUMNS = "列:"
ONE_CARD_HEADER = "表: "
NOT_FOUND = "未找到表: "
VECTOR_COLUMNS = " 字段: "
VECTOR_SEPARATOR = "、"
QUESTION_LABEL = "问题: "
SQL_LABEL = "SQL: "
FIELD_HINT = " 的真实字段（仅这些可用）: "
FIELD_UNKNOWN = ": 字段未知"
FINAL_SQL_HEADING = "最终"
REFUSAL = "本批无相关表"
CJK = "[一-龥]"
CUT_MARKER = "\n...(表结构已截断)"
NO_EXAMPLES = "无可用示例"
NO_KNOWLEDGE = "无可用知识库示例"
NO_GLOSSARY = "无业务名词配置"
NO_TABLES = "无可用表结构"
SELECTED_NOT_FOUND = "未找到指定的表: "

# Packing, scoring, history and admission defaults.
MAX_BATCH_CHARS = 20000
MIN_BLOCKS_PER_BATCH = 2
MAX_BATCHES = 5
TABLE_WEIGHT = 5.0
RANK_SHARE = 0.6
DISTANCE_SHARE = 0.4
BATCH_STEP = 0.1
HISTORY_LIMIT = 50
HISTORY_LIMIT_MAX = 200
PREVIEW_ROWS = 500
ERROR_CHARS = 1000
DISPLAY_CHARS = 800
QUERY_PREVIEW_CHARS = 100
CHUNK_CHARS = 512
CHUNK_OVERLAP = 50
ADMIT_MAX = 20
ADMIT_SECONDS = 60
ENCODE_BATCH = 50

# Upload types by pandas-style dtype name; anything else is text.
UPLOAD_TYPES = {
    "bigint": "bigint",
    "int": "bigint",
    "double": "double",
    "boolean": "boolean",
    "timestamp": "timestamp_ntz",
    "timestamp_ntz": "timestamp_ntz",
}
PROVIDERS = ("local", "api")
