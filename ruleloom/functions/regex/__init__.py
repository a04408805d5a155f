"""A portable regular grammar: parsing, matching in linear work, and translation to Java patterns."""

from ruleloom.functions.regex.java import fast_form, render
from ruleloom.functions.regex.nfa import Automaton, InputTooLarge, compile_pattern, test_pattern
from ruleloom.functions.regex.parser import PatternError, char_class_matches, parse, parse_ecma, range_contains, shorthand

__all__ = ["Automaton", "InputTooLarge", "PatternError", "char_class_matches", "compile_pattern", "fast_form", "parse", "parse_ecma", "range_contains", "render", "shorthand", "test_pattern"]
