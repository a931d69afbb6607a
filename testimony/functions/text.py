"""Scalar text functions as Spark columns: folding, name marks, phonetics, handles, query texts.

All are built from JVM functions, so they stay inside generated code.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and tables of the domain.
DIRECTIONS = "norte sur este oeste nororiente noroccidente n s e o".split()
ROMANS = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "xi": "11", "xii": "12", "xiii": "13"}
TYPE_WORDS = (
    "edificio edif residencia residencias res resd conjunto torre torres bloque "
    "urbanizacion urb sector barrio parroquia municipio estado ciudad pais "
    "avenida av calle carrera zona quinta complejo residencial club hotel"
).split()
KINDS_OF_THING = {
    "edificio": "structure", "calle": "road", "avenida": "road", "carrera": "road", "autopista": "road",
    "vialidad": "road", "vialidad y puentes": "road", "pais": "area", "estado": "area", "municipio": "area",
    "parroquia": "area", "populated_place": "area", "urbanizacion": "area", "barrio": "area", "sector": "area",
    "zona": "area", "plaza": "area",
}
PARTICLES = "de del la las los y e da do dos van von san santa".split()
NOISE_WORDS = "de del la el los las un una unos unas y e o en a al por con sobre para su sus".split()
INSTITUTION_WORDS = (
    "edificio edif residencia residencias urbanizacion urb torre torres conjunto centro club hotel bar restaurant "
    "restaurante salon avenida av calle puente parque playa mision plaza sector barrio parroquia estado municipio marina "
    "bloque muelle balneario iglesia colegio escuela fuerzas guardia proteccion ejercito armada asamblea bomberos "
    "ministerio gobierno alcaldia policia cruz copernicus usar redan onu ee uu venezuela colombia argentina espana "
    "mexico catar estados republica israel qatar jordania chile peru panama brasil cuba uruguay ecuador turquia italia "
    "francia alemania portugal salvador unidad unidades equipo equipos brigada brigadas cuadrilla comision rescatistas "
    "voluntarios voluntarias estudiantes vecinos vecinas familiares habitantes damnificados sobrevivientes autoridades "
    "funcionarios personal tropas militares efectivos agentes topos delegacion comando cuerpo cuerpos grupo grupos "
    "instituto universidad hospital clinica ambulatorio refugio albergue fundacion organizacion asociacion camara empresa "
    "consorcio embajada consulado gobernacion prefectura defensa direccion servicio servicios sistema aerolinea "
    "aeropuerto puerto terminal metro hidrocapital corpoelec pdvsa inameh funvisis sismologico res resd consejo junta "
    "comite cooperativa complejo residencial quinta posada hostal farmacia supermercado abasto panaderia mercado liceo "
    "guarderia ancianato asilo cancha estadio gimnasio autopista carretera via viaducto quebrada rio cerro loma punta "
    "bahia ensenada malecon litoral costa region zona area paramedico paramedicos medico medicos enfermeras enfermeros "
    "doctores socorristas buzos rescatista camilleros islas isla archipielago golfo analisis necesidades informe reporte"
).split()
ENGLISH_MARKERS = "the and of was with not".split()
SPANISH_MARKERS = "el la los de que con".split()


def _accents() -> tuple[str, str]:
    """Letters that decompose into one base character and marks, with their bases; made from Unicode's own table."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()


def _among(c: Column, words: list[str]) -> Column:
    return c.isin(*words)


def _lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value for ``c`` or null; tables here are short."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def fold(c: Column) -> Column:
    """Lower case, no accents or combining marks, single spaces, trimmed. Null stays null."""
    bare = F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _PLAIN), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def words(c: Column, pattern: str = " ") -> Column:
    return F.filter(F.split(c, pattern), lambda w: w != "")


def roman_to_number(c: Column) -> Column:
    return F.coalesce(_lookup(c, ROMANS), c)


def reduce_name(c: Column) -> Column:
    """Folded, without punctuation and one leading type word (if more follows), numerals as numbers."""
    w = words(F.regexp_replace(fold(c), r"[^\p{L}\p{N}\s]", ""), r"\s+")
    rest = F.when((F.size(w) > 1) & _among(F.get(w, F.lit(0)), TYPE_WORDS), F.slice(w, 2, F.size(w) - 1)).otherwise(w)
    return F.array_join(F.transform(rest, roman_to_number), " ")


def marks(c: Column) -> Column:
    """Sorted directions, numerals as numbers, and digit runs of the reduced name."""
    tokens = words(reduce_name(c), r"[^\p{L}\p{N}]+")
    found = F.transform(
        tokens,
        lambda t: F.when(_among(t, DIRECTIONS), F.array(t)).when(t.isin(*ROMANS), F.array(roman_to_number(t))).otherwise(F.regexp_extract_all(t, F.lit(r"(\d+)"))),
    )
    return F.array_sort(F.flatten(found))


def marks_contradict(a: Column, b: Column) -> Column:
    one, other = marks(a), marks(b)
    return (F.size(one) > 0) & (F.size(other) > 0) & (one != other)


def digit_marks(c: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(F.coalesce(fold(c), F.lit("")), F.lit(r"(\d+)")))


def kind_head(c: Column) -> Column:
    return F.coalesce(F.get(words(fold(c)), F.lit(0)), F.lit(""))


def kind_of_thing(c: Column) -> Column:
    return _lookup(fold(c), KINDS_OF_THING)


def phonetic_es(c: Column) -> Column:
    """A Spanish word as it sounds; the rules apply in this order."""
    rules = [("v", "b"), ("h", ""), ("ll", "y"), ("qu", "k"), ("gu([ei])", "g$1"), ("c([ei])", "s$1"), ("z", "s"), ("c", "k"), ("y", "i"), (r"(.)\1+", "$1")]
    out = fold(c)
    for pattern, to in rules:
        out = F.regexp_replace(out, pattern, to)
    return out


def name_keys(c: Column) -> Column:
    return F.filter(F.transform(words(fold(c)), phonetic_es), lambda w: w != "")


def theme_words(c: Column) -> Column:
    """Words that carry a theme's meaning, numerals as numbers."""
    w = words(F.regexp_replace(fold(c), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.filter(F.transform(w, roman_to_number), lambda x: ~_among(x, NOISE_WORDS))


def derive_handle(c: Column) -> Column:
    """struct(handle, reason): 'First L.' from a full name, or why none can be derived."""
    t = words(F.regexp_replace(c, r"(?U)\s+", " "))
    initial = F.upper(F.left(F.element_at(t, F.when(F.size(t) >= 3, -2).otherwise(-1)), F.lit(1)))
    reason = F.when(c.isNull(), "not_a_string").when(F.size(t) < 2, "too_few_tokens").when(F.exists(t, lambda x: _among(fold(x), PARTICLES)), "has_particle")
    return F.struct(F.when(reason.isNull(), F.concat(F.get(t, F.lit(0)), F.lit(" "), initial, F.lit("."))).alias("handle"), reason.alias("reason"))


# Words that join two names, and words that may lead a name without being of it.
JOINING_WORDS = ["de", "del", "la", "las", "los", "y", "e"]
LEADING_WORDS = ["el", "la", "los", "las", "un", "una", "en", "de", "del", "desde", "tras", "con", "por", "para", "durante", "segun", "según", "hasta", "ante", "sobre", "entre", "al", "a"]
_MARK = "\x01"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def capitalised_runs(c: Column) -> Column:
    """Runs of two or more capitalised words of two letters or more; between two of them stand spaces, or spaces and one joining word.

    The text is cut into letters, spaces and the rest; each capitalised word is joined to the one before by what stands between, so a run may be of any length.
    """
    name = lambda x: x.rlike(r"^\p{Lu}\p{L}+$")
    # A run may begin inside a word, at its first capital that a letter follows.
    begins = lambda x: F.regexp_extract(x, r"\p{Lu}\p{L}+", 0)

    def marked(t: Column) -> Column:
        at = lambda i: F.coalesce(F.when(i >= 0, F.get(t, i)), F.lit(""))
        space = lambda i: at(i).rlike(r"^\s+$")

        def piece(x: Column, i: Column) -> Column:
            near = name(x) & space(i - 1) & (begins(at(i - 2)) != "")
            over = name(x) & space(i - 1) & at(i - 2).isin(JOINING_WORDS) & space(i - 3) & (begins(at(i - 4)) != "")
            return F.when(near, F.concat(at(i - 1), x)).when(over, F.concat(at(i - 3), at(i - 2), at(i - 1), x)).when(begins(x) != "", F.concat(F.lit(_MARK), begins(x))).otherwise("")

        return F.transform(t, piece)

    tokens = F.regexp_extract_all(c, F.lit(r"\p{L}+|\s+|[^\p{L}\s]+"), F.lit(0))
    runs = F.split(F.array_join(_let(tokens, marked), ""), _MARK)
    return F.filter(runs, lambda x: x.rlike(r"\s"))


def without_leading(c: Column) -> Column:
    """A run of words without its leading articles and prepositions; the last word stays."""
    each = F.regexp_extract_all(c, F.lit(r"\S+\s*"), F.lit(0))
    first = lambda w: F.array_position(F.transform(w, lambda x: F.lower(F.regexp_extract(x, r"\S+", 0)).isin(LEADING_WORDS)), F.lit(False))
    rest = lambda w: F.array_join(F.slice(w, F.when(first(w) > 0, first(w)).otherwise(F.size(w)).cast("int"), F.greatest(F.size(w), F.lit(1))), "")
    return F.when(F.length(c) > 0, _let(each, rest)).otherwise(c)


def private_name_candidates(c: Column) -> Column:
    """Capitalised runs of two words or more, lists split, leading articles gone, institutions left out."""
    parts = F.flatten(F.transform(capitalised_runs(c), lambda x: F.split(x, r"\s+[ye]\s+")))
    bare = F.transform(parts, without_leading)
    person = lambda x: (F.size(words(x, r"\s+")) >= 2) & ~_among(F.get(words(fold(x)), F.lit(0)), INSTITUTION_WORDS)
    return F.array_distinct(F.filter(bare, person))


def strip_declared_names(role: Column, names: Column) -> Column:
    """``role`` without the given names (longest first), separators tidied; blank becomes null."""
    longest = F.array_sort(F.filter(names, lambda n: F.length(F.trim(n)) > 0), lambda a, b: F.length(b) - F.length(a))
    bare = F.aggregate(longest, role, lambda text, n: F.replace(text, n, F.lit("")))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[\s,;:\-–—]+|[\s,;:\-–—]+$", ""))
    return F.when(tidy != "", tidy)


def strip_fence(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def parse_confidence(c: Column) -> Column:
    """A number, or the number a string begins with; else null."""
    return F.nullif(F.regexp_extract(F.trim(c.cast("string")), r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1), F.lit("")).cast("double")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def clean_post_text(c: Column) -> Column:
    """Folded, without links, @mentions and #hashtags."""
    bare = F.regexp_replace(fold(c), r"https?://\S+|www\.\S+|[@#][\p{L}\p{N}_]+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def excerpt(c: Column, n: int = 180) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def short_id(c: Column) -> Column:
    return F.left(c.cast("string"), F.lit(8))


def note_language(c: Column) -> Column:
    count = lambda ws: F.size(F.regexp_extract_all(F.lower(c), F.lit(rf"(?:^|\W)({'|'.join(ws)})(?=\W|$)")))
    return F.when(count(ENGLISH_MARKERS) > count(SPANISH_MARKERS), "en").otherwise("es")


# --- query texts ----------------------------------------------------------------------------------


def quoted(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit(r"\s")), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)


def any_of(members: Column) -> Column:
    """Members joined by OR, in parentheses from two on; null for none."""
    joined = F.array_join(F.transform(members, quoted), " OR ")
    return F.when(F.size(members) == 1, joined).when(F.size(members) > 1, F.concat(F.lit("("), joined, F.lit(")")))


def query_text(names: Column, qualifiers: Column, terms: Column, since: Column, until: Column, mode: Column) -> Column:
    """The canonical request. ``qualifiers`` (null or empty for raw names) anchor the one name before them."""
    place = F.concat_ws(" ", any_of(names), any_of(qualifiers))
    suffix = F.concat(F.lit("queryType="), F.initcap(mode))
    bound = lambda n, t: F.concat(F.lit(f"{n}:"), F.unix_seconds(t).cast("string"))
    return F.concat_ws(" ", place, any_of(terms), bound("since_time", since), bound("until_time", until), suffix)


def result_mode(c: Column) -> Column:
    return F.when(c.endswith(" queryType=Latest"), "latest").when(c.endswith(" queryType=Top"), "top")


def decode_query(c: Column) -> Column:
    query = F.regexp_replace(c, r" queryType=(Latest|Top)$", "")
    epoch = lambda n: F.nullif(F.regexp_extract(query, rf"(?:^|\s){n}:(\d+)", 1), F.lit("")).cast("long")
    return F.struct(query.alias("query"), result_mode(c).alias("mode"), epoch("since_time").alias("since_time"), epoch("until_time").alias("until_time"))


def operator_count(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r" queryType=(Latest|Top)$", ""), r"[()]", " ")
    return F.size(F.regexp_extract_all(bare, F.lit(r'("[^"]*"|\S+)')))


# --- prose ----------------------------------------------------------------------------------------


def join_y(items: Column) -> Column:
    """Spanish list: 'a, b y c'."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" y "), F.element_at(items, -1)))


def thousands(c: Column) -> Column:
    return F.translate(F.format_number(c.cast("long"), 0), ",", ".")


def _clause(theme: Column, person: Column, subject: Column, status: Column, magnitude: Column) -> Column:
    m = lambda *keys: F.coalesce(*[magnitude[k] for k in keys])
    hours = m("hours", "horas")
    trapped = F.when(hours.isNotNull(), F.concat(F.lit(", tras "), hours.cast("string"), F.lit(" horas bajo los escombros"))).otherwise("")
    who = F.coalesce(person, F.lit(""))
    count = lambda v: F.coalesce(thousands(F.try_to_number(v, F.lit("999999999999"))), v)
    dead, hurt = m("fallecidos", "muertos", "deaths"), m("heridos", "injured")
    parts = F.filter(F.array(F.concat(count(dead), F.lit(" fallecidos")), F.concat(count(hurt), F.lit(" heridos"))), lambda x: x.isNotNull())
    toll = F.when(F.size(parts) == 0, "el balance oficial fue actualizado").otherwise(F.concat(F.lit("el balance oficial reportó "), join_y(parts)))
    trimmed = F.trim(F.coalesce(theme, F.lit("")))
    what = F.concat(F.lower(F.left(trimmed, F.lit(1))), F.substring(trimmed, 2, 10_000))
    whom = F.coalesce(person, subject)
    article = F.when(F.rlike(what, F.lit(r"^(un|una|el|la|los|las) ")), "").when(F.rlike(what, F.lit(r"^[^\s]*(a|ción|sión|dad)(?=[^\p{L}\p{N}_]|$)")), "una ").otherwise("un ")
    generic = (
        F.when((what == "") & whom.isNull(), "se registró un hecho")
        .when(what == "", F.concat(F.lit("se registró un hecho relativo a "), whom))
        .when(whom.isNull(), F.concat(F.lit("se registró "), article, what))
        .otherwise(F.concat(F.lit("se registró "), article, what, F.lit(", relativo a "), whom))
    )
    k = F.lower(F.coalesce(theme, F.lit("")))
    alive = F.rlike(F.coalesce(status, F.lit("")), F.lit("rescatad|salvad|con vida"))
    return (
        F.when(F.rlike(k, F.lit("cifra|balance|damnific")), toll)
        .when(F.rlike(k, F.lit("colaps|derrumb|desplom")), "el edificio colapsó tras el terremoto")
        .when(F.rlike(k, F.lit("desaparec|búsqueda|busqueda|buscan|paradero|localiz")), F.concat(F.lit("se buscaba a "), who))
        .when(F.rlike(k, F.lit("cuerpo|fallec|muert|cadáver|cadaver|víctima|victima")), F.concat(F.lit("fue recuperado el cuerpo de "), F.coalesce(person, F.lit("una persona"))))
        .when(F.rlike(k, F.lit("rescat[ae]|salvad")), F.concat(F.when(alive, "los equipos rescataron con vida a ").otherwise("los equipos trabajaron para rescatar con vida a "), who, trapped))
        .otherwise(generic)
    )


def clause_text(theme: Column, person: Column, subject: Column, status: Column, magnitude: Column, support: Column) -> Column:
    """One clause of prose for a claim, attributed when the support gate flagged it."""
    text = _clause(theme, person, subject, status, magnitude)
    return F.when(support.isin("overstated", "unsupported"), F.concat(F.lit("según un reporte sin confirmar, "), text)).otherwise(text)
