"""They must equal the domain's own values for right results."""

# --- fixed values: states, question types, methods -------------------------
VALIDATED = "VALIDADA"
REVIEW = "A_REVISAR"
REJECTED = "RECHAZADA"
PENDING = "PENDIENTE"
ACCEPTED = "ACEPTADA"
VERDICT_STATES = ("VALIDADA", "A_REVISAR", "RECHAZADA")

THEORY = "ESPECIAL_TEORIA"
PRACTICE = "ESPECIAL_PRACTICA"
INFORMATICS = "ESPECIAL_INFORMATICA"
GENERAL = "GENERAL"
BLOCK_ORDER = (THEORY, PRACTICE, INFORMATICS, GENERAL)
OFFICIAL_TOTALS = {THEORY: 50, PRACTICE: 15, INFORMATICS: 15, GENERAL: 30}

# first and last exam position of each question type
POSITION_RANGES = (
    (1, 50, THEORY),
    (51, 65, PRACTICE),
    (66, 80, INFORMATICS),
    (81, 110, GENERAL),
)
ORIGIN_PART = {INFORMATICS: "Especial-Informática", GENERAL: "General"}
DEFAULT_ORIGIN_PART = "Especial-Teoría"

LETTERS = ("A", "B", "C", "D")
BLANK_ANSWER = "En blanco"

METHOD_DIRECT = "DIRECTA"
METHOD_BM25 = "BM25"
METHOD_BM25_MODEL = "BM25_IA"
METHOD_BM25_DOC = "BM25_DOCUMENTO"
METHOD_BM25_DOC_MODEL = "BM25_IA_DOCUMENTO"
METHOD_FOOTER = "PIE_DIRECTO"
METHOD_OVERRIDE = "MODELO_REVISION_MANUAL"
METHOD_SUBJECT = "MATERIA_INFORMATICA"

# --- fixed values: retrieval -------------------------------------------------
STOP_WORDS = (
    "a", "al", "ante", "bajo", "con", "contra", "de", "del", "desde",
    "durante", "e", "el", "ella", "en", "entre", "es", "esta", "este", "la",
    "las", "lo", "los", "o", "para", "por", "que", "se", "segun", "sin",
    "sobre", "su", "sus", "un", "una", "y",
)
BM25_K1 = 1.5
BM25_B = 0.75
CANDIDATES = 5

# --- fixed values: thresholds ------------------------------------------------
MIN_CONFIDENCE = 0.50
AUTO_CONFIDENCE = 0.95
CHUNK_CHARS = 3000
CONTEXT_CHARS = 18000
BATCH_ITEMS = 20
PRACTICAL_POINTS = 5
TOP_ERRORS = 8

# --- fixed values: citations -------------------------------------------------
ARTICLE_SUFFIXES = ("bis", "ter", "quater")
HEADING_SUFFIXES = (
    "bis", "ter", "quater", "quinquies", "sexies", "septies", "octies",
    "nonies", "decies",
)
SPECIAL_ALIASES = {
    "CE": ("constitucion española", "constitucion", "ce"),
    "RLC": (
        "reglamento de les corts",
        "reglamento de las corts",
        "reglamento de les corts valencianes",
    ),
    "TFUE": (
        "tratado de funcionamiento de la union europea",
        "tratado funcionamiento union europea",
        "tfue",
    ),
    "TUE": ("tratado de la union europea", "tratado union europea", "tue"),
    "LO5_1982": (
        "ley organica 5/1982",
        "estatuto de autonomia",
        "estatuto de autonomia de la comunitat valenciana",
        "estatuto de autonomia de la comunidad valenciana",
        "eacv",
    ),
    "DL5_2015": (
        "real decreto legislativo 5/2015",
        "decreto legislativo 5/2015",
        "trebep",
        "texto refundido del estatuto basico del empleado publico",
        "estatuto basico del empleado publico",
    ),
    "LO3_2018": (
        "ley organica 3/2018",
        "ley organica de proteccion de datos personales",
        "proteccion de datos personales",
        "garantia de los derechos digitales",
        "lopdgdd",
    ),
}
SPECIAL_PREFIXES = {
    "CE": "Constitucion Española",
    "RLC": "Reglamento de Les Corts",
    "TFUE": "Tratado Funcionamiento Union Europea",
    "TUE": "Tratado Union Europea",
}
KIND_PREFIXES = {
    "DL": "Decreto Legislativo ",
    "LO": "Ley Orgánica ",
    "D": "Decreto ",
    "L": "Ley ",
}
SUBJECT_TOPICS = {
    "INFORMATICA_BASICA": 15,
    "WINDOWS_11": 16,
    "EXPLORADOR_WINDOWS_11": 17,
    "OUTLOOK_365": 18,
    "WORD_365": 19,
    "EXCEL_365": 20,
    "TEAMS_365": 21,
    "NAVEGADORES_WEB": 22,
    "INTELIGENCIA_ARTIFICIAL": 23,
}

# --- fixed values: model prices per million tokens (input, output) -----------
MODEL_PRICES = {
    "gpt-5-mini": (0.75, 4.50),
    "gpt-5.4": (2.50, 15.00),
    "gpt-5.4-mini": (0.75, 4.50),
}

# --- fixed values: typographic ligatures --------------------------------------
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi",
    "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st",
}

# --- fixed values: word patterns of the practical-case score (accent-free) ----
EXPLICIT_CASE = (
    "suponga que", "supongamos que", "imagine que", "en el supuesto de que",
    "supuesto de hecho", "caso planteado",
)
CONCRETE_SUBJECT = (
    "fructuosa", "mariano", "(?:el|un) funcionario", "(?:la|una) funcionaria",
    "(?:el|un) interesado", "(?:la|una) interesada", "(?:el|un) particular",
    "(?:la|una) ciudadana", "(?:el|un) ciudadano", "(?:la|una) conselleria",
    "conselleria [a-z]", "(?:la|una) direccion general",
    "(?:el|un) director general", "(?:el|un) ayuntamiento",
    "(?:el|un) organo de contratacion", "(?:la|una) intervencion delegada",
    "(?:la|una) empresa", "(?:el|un) licitador", "persona tecnica encargada",
    "jefa de seccion",
)
NAMED_SUBJECT_VERBS = (
    "es", "se encuentra", "ha", "presenta", "solicita", "interpone",
    "pretende", "ocupa",
)
MONTHS = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
    "septiembre", "octubre", "noviembre", "diciembre",
)
YEAR_PATTERN = r"(?U)\b20\d{2}\b"
PERCENT_PATTERN = r"(?U)\d+\s*%"
NUMBER_PATTERN = r"(?U)\b\d+[.,]?\d*\b"
ACRONYM_PATTERN = r"(?U)\b[A-Z]{2,}\b"
DATE_PATTERN = r"(?iU)\b\d{{1,2}}\s+de\s+(?:{months})(?:\s+de\s+\d{{4}})?\b"
AMOUNT_PATTERN = r"(?iU)\b\d{1,3}(?:\.\d{3})*(?:,\d+)?\s*euros\b"
SEQUENCE_WORDS = (
    "posteriormente", "despues", "tras", "mas tarde", "de nuevo", "finalmente",
)
ACTION_WORDS = (
    "solicita", "presenta", "modifica", "resuelve", "dicta", "notifica",
    "tramita", "incoa", "adjudica", "autoriza", "deniega", "aprueba", "acuerda",
)

# --- fixed values: feature profile of an exam (accent-free) --------------------
OPENINGS = (
    "según", "señale", "indique", "de acuerdo con", "conforme a", "cuál",
    "qué", "cómo", "quién", "en relación con",
)
PERSON_PHRASES = (
    "juan", "maria", "fructuosa", "mariano", "un funcionario",
    "una funcionaria", "un interesado", "una interesada", "un particular",
    "una ciudadana", "un ciudadano",
)
ORGAN_PHRASES = (
    "la conselleria", "una conselleria", "la direccion general",
    "el director general", "el ayuntamiento", "un ayuntamiento",
    "el organo de contratacion", "la intervencion delegada",
)
NARRATIVE_PHRASES = (
    "pretende", "presenta", "solicita", "interpone", "dicta", "tramita",
    "incoa", "convoca", "ha sido", "va a", "se plantea",
)

# --- fixed values: reason texts -------------------------------------------------
REASON = {
    "no_norm": "No se ha detectado una norma explícita.",
    "many_norms": (
        "La pregunta hace referencia a varias normas distintas y no sigue el "
        "formato admitido por el proyecto."
    ),
    "norm_outside": "La norma citada no pertenece al temario.",
    "no_article": "La norma pertenece al temario, pero no se cita artículo.",
    "article_outside": (
        "La norma pertenece al temario, pero el artículo citado no está incluido."
    ),
    "covered": "La norma y el artículo citados pertenecen al temario.",
    "many_topics": (
        "La norma y el artículo pertenecen al temario, pero están asociados a "
        "varios temas."
    ),
    "footer_blank": "No se ha podido identificar la norma del pie.",
    "footer_outside": "La norma no pertenece al temario.",
    "footer_many_norms": "La referencia normativa coincide con varias normas.",
    "footer_no_article": (
        "La norma pertenece al temario, pero no se ha identificado el artículo."
    ),
    "footer_bad_article": "El artículo extraído no tiene un formato reconocible.",
    "footer_article_outside": (
        "La norma pertenece al temario, pero el artículo no está incluido."
    ),
    "footer_covered": "La norma y el artículo del pie pertenecen al temario.",
    "no_fragments": "BM25 no ha localizado fragmentos candidatos dentro del temario.",
    "no_documents": "BM25 no ha localizado documentos candidatos de Informática.",
    "bad_verdict": "No se pudo interpretar de forma segura la respuesta de la IA: ",
    "fragment_unrelated": (
        "El fragmento fue seleccionado, pero no pudo relacionarse con el temario."
    ),
    "fragment_many": (
        "El fragmento respalda la respuesta, pero está asociado a varios temas."
    ),
    "document_many": (
        "El documento respalda la respuesta, pero está asociado a varios temas."
    ),
    "not_acceptable": (
        "No puede incorporarse automáticamente: falta tema válido o respuesta "
        "correcta."
    ),
}
VERDICT_ERROR = {
    "not_object": "La respuesta de la IA no es un objeto JSON.",
    "decision": "Decisión IA no válida: ",
    "confidence_type": "La confianza de la IA no es numérica.",
    "confidence_range": "La confianza debe estar entre 0 y 1.",
    "rejected_with_id": "Una respuesta RECHAZADA debe tener fragmento_id null.",
    "id_type": "fragmento_id debe ser un entero.",
    "not_offered": (
        "La IA ha seleccionado un fragmento que no estaba entre los candidatos."
    ),
}
PREPARE_ERROR = {
    "page": "El número de página no es válido.",
    "stem": "La pregunta no tiene enunciado.",
    "options": "La pregunta no contiene opciones.",
    "option": "No se ha extraído la opción {}.",
    "answer": "No se ha detectado una respuesta correcta válida.",
}
PARSE_ERROR = {
    "count": "No se detectaron exactamente cuatro opciones.",
    "order": "Las opciones no siguen el orden A, B, C y D.",
    "stem": "El enunciado está vacío.",
    "blank": "Alguna opción está vacía.",
}
EXTRACTION_NOTE = {
    "number": "No se detectó el número visible; se utiliza el número de página.",
    "option": "No se extrajo la opción {}.",
    "answer": "La respuesta correcta detectada no es válida.",
}
ALIGN_NOTE = {
    "missing": "La IA no devolvió resultado.",
    "answer": "Respuesta correcta no válida.",
    "subject": "Materia no válida.",
}

# bundles of small texts
RECORD = "\x1e"  # stands before every text
BUNDLE = 1_000  # texts a file
