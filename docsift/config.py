"""Engine configuration: one frozen dataclass handed to every job."""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being reproduced, so they are
# stated here as plain text, in their natural order, in one place.
# ---------------------------------------------------------------------------
CHUNK_SIZE = 300
CHUNK_OVERLAP = 50
EMBEDDING_DIM = 384
SEARCH_TOP_K = 5
RETRIEVE_TOP_K = 3
PROMPT_PREFIX_CHARS = 500
SEPARATORS = ("\n\n", "\n", " ", "")
SUPPORTED_EXTENSIONS = (".pdf", ".txt", ".md")
LIST_PHRASES = (
    "list documents",
    "show documents",
    "what documents do you have",
    "list all document titles",
)
RETRIEVE_KEYWORDS = ("information", "details", "document", "explain", "describe")
NO_INFO_MARKER = "does not provide information"
NO_RELEVANT_ANSWER = "No relevant information was found in any of the documents."
NO_DOCUMENTS_MESSAGE = "No documents found in the database."
TITLES_HEADER = "Here are the available documents:\n"
APOLOGY = "Sorry, I'm unable to generate a response at the moment. Please try again later."
PROMPT_TEMPLATE = "Based on the following content:\n\n{content}\n\nAnswer the question: {query}"
ANSWER_TEMPLATE = "Document ID: {doc_id}\nFile Path: {file_path}\nResponse:\n{response}\n"
ANSWER_JOINER = "\n\n"
STATUS_PROCESSED = "processed"
SYSTEM_PROMPT = (
    "You are a knowledgeable assistant. Your primary function is to provide "
    "information strictly based on the embedded documents. When answering queries, "
    "ensure your responses are concise and directly related to the content of the "
    "documents. If possible, always include the title of the source document in your "
    "response to indicate the origin of the information. If a query cannot be answered "
    "from the documents, state that explicitly and suggest checking another document "
    "or a different source. If a query requests general information or opinions, make "
    "it clear that your primary function is to provide information based on the embedded documents."
)
# Characters Python's str.isspace() accepts (used by strip()), and the ones
# str.splitlines() breaks on. Written as regex classes valid in Java and RE2.
PY_WHITESPACE_CLASS = r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PY_LINEBREAK_CLASS = r"[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    dim: int = EMBEDDING_DIM
    top_k: int = SEARCH_TOP_K
    retrieve_k: int = RETRIEVE_TOP_K
    prefix_chars: int = PROMPT_PREFIX_CHARS
    separators: tuple[str, ...] = SEPARATORS
    supported_extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS
    list_phrases: tuple[str, ...] = LIST_PHRASES
    keywords: tuple[str, ...] = RETRIEVE_KEYWORDS
    system_prompt: str = SYSTEM_PROMPT
    # Largest side of a search (bytes, float64 matrix) that is broadcast, and
    # the size of a query block when both sides are larger.
    max_query_block_bytes: int = 64 * 1024 * 1024
    # Partial top-k lists of a query that its last ranking gets.
    top_k_fan_in: int = 64
    # Largest side broadcast by a join whose size is only known at run time.
    max_broadcast_rows: int = 2_000_000
    max_broadcast_bytes: int = 256 * 1024 * 1024
    # Documents longer than this are chunked cell by cell across tasks.
    split_doc_chars: int = 1_000_000

    def with_(self, **kw) -> "EngineConfig":
        return replace(self, **kw)


DEFAULT = EngineConfig()
