"""Fixed values of the statutory domain."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: The central table: one extracted statement per row. article_number is text ('14^2', 'IV', 'unic').
TRIPLES = StructType(
    [
        StructField("head", StringType()),
        StructField("relation", StringType()),
        StructField("tail", StringType()),
        StructField("law_id", StringType()),
        StructField("article_number", StringType()),
        StructField("source_method", StringType()),
        StructField("confidence", DoubleType()),
    ]
)
TRIPLE_COLS = TRIPLES.fieldNames()

REGEX_CONFIDENCE = 1.0
LLM_CONFIDENCE = 0.7

# The closed relation vocabulary.
RELATIONS = (
    "emis_de",
    "promulgat_de",
    "publicat_în",
    "modifică",
    "completează",
    "abroga",
    "introduce",
    "republică",
    "aprobă",
    "face_referire_la",
    "intră_în_vigoare",
    "are_sediul_în",
    "responsabil_pentru",
    "colaborează_cu",
    "se_aplică",
    "transpune",
)

# Synonyms of relations, lower case with underscores.
RELATION_SYNONYMS = {
    "publicată_în": "publicat_în",
    "publicate_în": "publicat_în",
    "publicat": "publicat_în",
    "emisă_de": "emis_de",
    "emise_de": "emis_de",
    "emis": "emis_de",
    "modifică_pe": "modifică",
    "modificată": "modifică",
    "modifica": "modifică",
    "promulgată_de": "promulgat_de",
    "abrogă": "abroga",
    "abrogată": "abroga",
    "abrogat": "abroga",
    "republicată": "republică",
    "republicat": "republică",
    "aprobată": "aprobă",
    "aprobat": "aprobă",
    "intra_în_vigoare": "intră_în_vigoare",
    "se_referă_la": "face_referire_la",
    "referă_la": "face_referire_la",
    "completată": "completează",
    "completată_de": "completează",
}

# Ontology axioms by relation.
FUNCTIONAL = ("emis_de", "promulgat_de", "publicat_în")
ASYMMETRIC = ("modifică", "completează", "abroga")
IRREFLEXIVE = ("emis_de", "promulgat_de", "modifică", "completează", "abroga")
TRANSITIVE = ("modifică",)
SYMMETRIC = ("colaborează_cu",)
TAIL_DOMAIN = {
    "emis_de": ("Parlamentul României", "Guvernul României"),
    "promulgat_de": ("Klaus Iohannis", "Președintele României"),
    "publicat_în": ("Monitorul Oficial al României",),
}
#: Relations by which one act refers to another.
CROSS_REFERENCES = ("modifică", "completează", "abroga", "introduce", "republică", "aprobă", "face_referire_la", "transpune")

# Act types (as lookup keys) and the prefix of their identifiers.
ACT_PREFIX = {
    "lege": "lege",
    "legea": "lege",
    "lege-cadru": "lege",
    "ordonanta de urgenta": "oug",
    "ordonanta de urgenta a guvernului": "oug",
    "oug": "oug",
    "o.u.g": "oug",
    "ordonanta": "og",
    "ordonanta guvernului": "og",
    "ordonanta a guvernului": "og",
    "og": "og",
    "o.g": "og",
    "hotarare": "hg",
    "hotarare de guvern": "hg",
    "hotararea guvernului": "hg",
    "hg": "hg",
    "h.g": "hg",
    "decret": "decret",
    "constitutia": "constitutia",
    "constitutia romaniei": "constitutia_romaniei",
}

# Named codes (as lookup keys) and the acts they are.
CODE_NAMES = {
    "codul muncii": "lege_53_2003",
    "codul fiscal": "lege_227_2015",
    "codul civil": "lege_287_2009",
    "codul penal": "lege_286_2009",
    "codul administrativ": "oug_57_2019",
    "codul de procedura civila": "lege_134_2010",
    "codul de procedura penala": "lege_135_2010",
    "constitutia": "constitutia_romaniei",
    "constitutia romaniei": "constitutia_romaniei",
}

# Month names.
MONTHS = ("ianuarie", "februarie", "martie", "aprilie", "mai", "iunie", "iulie", "august", "septembrie", "octombrie", "noiembrie", "decembrie")

# First words of entities that are written with a capital.
LAW_WORDS = ("legea", "codul", "hotărârea", "ordonanța", "decretul", "constituția", "monitorul", "parlamentul", "guvernul", "președintele", "ministerul")

# Weights of the compliance score.
SCORE_WEIGHTS = {"relation_jaccard": 0.20, "relation_distribution_cosine": 0.15, "node_jaccard": 0.10, "triple_jaccard": 0.05, "axiom_conformance": 0.50}

#: Characters stripped from the ends of lookup keys.
EDGE_PUNCTUATION = " \t\n\r.,;:\"'`«»“”’()[]{}"

#: Shape of an act identifier.
LAW_ID_SHAPE = r"^[a-z]+(?:_[0-9]+){2,}$"
