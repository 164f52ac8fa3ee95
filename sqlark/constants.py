"""They must equal the behaviour this library has to match."""

# Chunk sizes, strategies and embedding models of the sweep.
CHUNK_SIZES = (256, 512, 1536)
CHUNK_STRATEGIES = ("fixed", "nltk", "spacy")
EMBEDDING_MODELS = ("text-embedding-3-small", "text-embedding-3-large", "text-embedding-ada-002")
SHORTENING_MODEL = "text-embedding-3-large"

# Retrieval depth, chat length, label of the "no filter" choice.
TOP_K = 3
MAX_ROUNDS = 12
ALL_DATABASES = "All"

# Patterns that cut SQL out of a model's answer.
LOOSE_SQL_PATTERN = "(?s)`sql(.*?)`"
STRICT_SQL_PATTERN = "(?s)```sql(.*?)```"

# The stop word and the sentence shown for an empty message.
STOP_WORD = "TERMINATE"
EMPTY_MESSAGE = "Agents are working on the request..."

# Colours of the rendered transcript.
CONTENT_COLOUR = "blue"
CALL_COLOUR = "green"

# Fixed value: what a failed SQL statement yields instead of rows.
SQL_ERROR = "Error"
