"""Expression columns: normal form, identifiers, symbol lists and contracts.

Everything here is a native column expression, also the flattening of unknown calls:
an expression is cut into calls, words and single characters, each call is rewritten
on its own, and the pieces are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgrade.functions import text as tx
from sparkgrade.functions.text import MISSING, as_column

# Callables that keep their call form.
KNOWN_CALLABLES = [
    "Eq", "Ne", "Lt", "Le", "Gt", "Ge", "And", "Or", "Not",
    "sqrt", "log", "sin", "cos", "tan", "exp", "Abs", "Min", "Max",
    "Derivative", "Integral", "Sum", "Product", "Limit", "Piecewise", "Matrix",
]

# Names that are never symbols.
RESERVED_NAMES = KNOWN_CALLABLES + [
    "True", "False", "true", "false", "oo", "nan", "zoo", "pi", "E", "I", "and", "or", "not",
]

# Greek macros that become plain names, and their two variant forms.
GREEK_NAMES = [
    "alpha", "beta", "gamma", "delta", "epsilon", "theta", "kappa", "lambda", "mu", "nu",
    "xi", "pi", "rho", "sigma", "tau", "phi", "chi", "psi", "omega",
]
GREEK_VARIANTS = ["epsilon", "theta", "phi"]

# Operator spellings inside a flattened argument, longest first.
ARGUMENT_OPERATORS = [
    ("**", "_pow_"), ("^", "_pow_"), ("*", "_mul_"), ("/", "_div_"), ("+", "_plus_"), ("-", "_minus_"),
]

# A call without nested brackets, of a name that is not kept.
UNKNOWN_CALL = rf"(?!(?:{'|'.join(KNOWN_CALLABLES)})\b)[A-Za-z_]\w*\s*\([^(){{}}]*\)"
PIECES = rf"(?U){UNKNOWN_CALL}|\w+|\W+"
KEPT_CALL = rf"(?U)\b({'|'.join(KNOWN_CALLABLES)})\s*\(\s*([^(){{}}]*?)\s*\)"
IDENTIFIER = r"(?U)[A-Za-z_]\w*"

# Fixed value: heading of the symbol section of a question.
SYMBOL_HEADING = "Symbols (for final answer):"


def _squeeze(name: Column) -> Column:
    return F.btrim(F.regexp_replace(name, "_+", "_"), F.lit("_"))


def _argument_name(argument: Column) -> Column:
    """An argument as part of a name; most arguments are names already."""
    plain = argument.rlike("^[A-Za-z][A-Za-z0-9_]*$")
    return F.when(plain, argument).otherwise(_spelled_out(argument))


def _spelled_out(name: Column) -> Column:
    for operator, word in ARGUMENT_OPERATORS:
        name = F.replace(name, F.lit(operator), F.lit(word))
    name = tx.null_if_empty(_squeeze(F.regexp_replace(name, "[^A-Za-z0-9_]", "_")))
    # A name must not start with a digit.
    return F.regexp_replace(F.coalesce(name, F.lit("arg")), "^(?=[0-9])", "n_")


def _flatten_call(call: Column) -> Column:
    # A call piece is a name, blanks, and one bracket without brackets inside.
    name = tx.strip(F.substring_index(call, "(", 1))
    arguments = tx.strip(F.rtrim(F.substring_index(call, "(", -1), F.lit(")")))
    named = F.array_join(F.transform(F.split(arguments, r"\s*,\s*"), _argument_name), "_")
    flat = tx.null_if_empty(_squeeze(F.concat_ws("_", name, named)))
    return F.when(arguments == "", name).otherwise(F.coalesce(flat, name))


def _flatten_calls(expression: Column) -> Column:
    """Rewrite each unknown call of the expression; everything else stays as it is."""
    def rewrite(piece: Column) -> Column:
        is_call = F.endswith(piece, F.lit(")")) & piece.rlike(r"(?U)^\w")
        return F.when(is_call, _flatten_call(piece)).otherwise(piece)

    pieces = F.regexp_extract_all(expression, F.lit(PIECES), F.lit(0))
    return F.array_join(F.transform(pieces, rewrite), "")


def normalize_expression(expression: Column | str) -> Column:
    """Greek macros to names, unknown calls flattened (``u_i(D,R)`` -> ``u_i_D_R``).

    Each step runs only on expressions that can need it; the tests are cheap.
    """
    unknown = rf"(?U)(?<!\w){UNKNOWN_CALL}"

    def name_greek(body: Column) -> Column:
        plain = F.regexp_replace(body, rf"\\var({'|'.join(GREEK_VARIANTS)})\b", r"\\$1")
        plain = F.regexp_replace(plain, rf"\\({'|'.join(GREEK_NAMES)})\b", "$1")
        return F.when(F.contains(body, F.lit("\\")), plain).otherwise(body)

    def flatten_once(state: Column, _: Column) -> Column:
        open_call = F.contains(state, F.lit("(")) & state.rlike(unknown)
        return F.when(open_call, _flatten_calls(state)).otherwise(state)

    def flatten(body: Column) -> Column:
        # Each round flattens the innermost calls; there are no more rounds than brackets.
        brackets = F.length(body) - F.length(F.replace(body, F.lit("("), F.lit("")))
        rounds = F.sequence(F.lit(1), brackets)
        flat = F.regexp_replace(F.aggregate(rounds, body, flatten_once), KEPT_CALL, "$1($2)")
        has_call = F.contains(body, F.lit("(")) & body.rlike(r"(?U)\w\s*\(")
        return F.when(has_call, flat).otherwise(body)

    return tx.clean_text(tx.let(tx.let(tx.strip(expression), name_greek), flatten))


def tokens_of_normal(normal: Column) -> Column:
    """Sorted distinct identifiers of an expression in normal form."""
    # The sentinel for "no expression" holds no symbols.
    found = F.regexp_extract_all(F.regexp_replace(normal, f"^{MISSING}$", ""), F.lit(IDENTIFIER), F.lit(0))
    return F.array_sort(F.array_except(found, tx.words(RESERVED_NAMES)))


def symbol_tokens(expression: Column | str) -> Column:
    """Sorted distinct identifiers of an expression, reserved names left out."""
    return tokens_of_normal(normalize_expression(expression))


def _is_symbol(name: Column) -> Column:
    return name.rlike(r"(?U)^[A-Za-z_]\w*$") & ~F.array_contains(tx.words(RESERVED_NAMES), name)


def allowed_symbols(symbols: Column | str) -> Column:
    """Valid, not reserved, distinct and sorted; NULL gives an empty list."""
    trimmed = F.transform(as_column(symbols), lambda s: tx.strip(s))
    kept = F.array_sort(F.array_distinct(F.filter(trimmed, lambda s: s.isNotNull() & _is_symbol(s))))
    return F.coalesce(kept, F.array().cast("array<string>"))


def symbol_definitions(definitions: Column | str, allowed: Column) -> Column:
    """Definitions with valid keys, restricted to the allowed symbols when there are any."""
    entries = F.transform(
        F.map_entries(as_column(definitions)),
        lambda e: F.struct(
            tx.strip(e["key"]).alias("key"),
            F.coalesce(tx.strip(e["value"]), F.lit("")).alias("value"),
        ),
    )
    kept = F.filter(
        entries,
        lambda e: _is_symbol(e["key"]) & ((F.size(allowed) == 0) | F.array_contains(allowed, e["key"])),
    )

    def distinct(kept: Column) -> Column:
        return F.filter(
            kept,
            lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda x: x["key"] == e["key"]),
        )

    return F.map_from_entries(tx.let(kept, distinct))


def parse_contract(raw: Column | str) -> Column:
    """``struct<allowed_symbols, symbol_definitions>`` from JSON text; empty when unusable.

    The text is parsed once, and as one value: a struct made in the open would be taken apart
    by the optimiser and parsed again for each use of a field.
    """
    parsed = F.from_json(
        as_column(raw), "allowed_symbols array<string>, symbol_definitions map<string,string>"
    )

    def contract(parsed: Column, allowed: Column) -> Column:
        definitions = F.coalesce(
            symbol_definitions(parsed["symbol_definitions"], allowed),
            F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")),
        )
        return F.struct(allowed.alias("allowed_symbols"), definitions.alias("symbol_definitions"))

    return tx.let(parsed, lambda p: tx.let(allowed_symbols(p["allowed_symbols"]), lambda a: contract(p, a)))


def resolve_allowed(direct: Column | str, contract: Column | str, reference: Column | str) -> Column:
    """Allowed symbols: the direct list, else the contract, else the reference's identifiers."""
    listed = allowed_symbols(direct)
    contracted = parse_contract(contract)["allowed_symbols"]
    return (
        F.when(F.size(listed) > 0, listed)
        .when(F.size(contracted) > 0, contracted)
        .otherwise(symbol_tokens(reference))
    )


def symbol_mismatch(expression: Column | str, allowed: Column | str) -> Column:
    """Identifiers used but not allowed; an empty allowed list allows everything."""
    return off_list(symbol_tokens(expression), as_column(allowed))


def off_list(used: Column, allowed: Column) -> Column:
    """Used symbols that an (unless empty) list does not allow."""
    return F.when(F.size(allowed) > 0, F.array_except(used, allowed)).otherwise(F.array().cast("array<string>"))


def symbol_section(allowed: Column | str, definitions: Column | str) -> Column:
    """The section listing the allowed symbols, empty when there are none."""
    def line(symbol: Column) -> Column:
        meaning = F.coalesce(tx.strip(F.try_element_at(as_column(definitions), symbol)), F.lit(""))
        bullet = F.concat(F.lit("- `"), symbol, F.lit("`"))
        return F.when(meaning != "", F.concat(bullet, F.lit(": "), meaning)).otherwise(bullet)

    lines = F.array_join(F.transform(as_column(allowed), line), "\n")
    return F.when(F.size(as_column(allowed)) > 0, F.concat(F.lit(SYMBOL_HEADING + "\n"), lines)).otherwise("")


def _two_parts(first: Column, second: Column) -> Column:
    return F.when(first == "", second).otherwise(F.concat(first, F.lit("\n\n"), second))


def ensure_symbol_section(question: Column | str, allowed: Column | str, definitions: Column | str) -> Column:
    """Append the section unless the question already has one."""
    body = F.coalesce(tx.strip(question), F.lit(""))
    section = symbol_section(allowed, definitions)
    keep = (section == "") | F.contains(body, F.lit(SYMBOL_HEADING))
    return F.when(keep, body).otherwise(_two_parts(body, section))


def replace_symbol_section(question: Column | str, allowed: Column | str, definitions: Column | str) -> Column:
    """Swap an existing section for the canonical one, or append it."""
    body = F.coalesce(tx.strip(question), F.lit(""))
    section = symbol_section(allowed, definitions)
    before = F.regexp_replace(F.substring_index(body, SYMBOL_HEADING, 1), r"(?U)\s+$", "")
    return F.when(section == "", body).otherwise(_two_parts(before, section))
