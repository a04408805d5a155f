"""ruleloom: three-valued rules and formulas compiled to Catalyst columns."""
