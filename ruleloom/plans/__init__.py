"""Trees: reading, building, lowering to Catalyst columns, SQL text."""
