"""Where a rule's values come from: bindings to columns, tables, catalogues and documents."""
