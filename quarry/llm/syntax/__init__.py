"""Token streams, grammars and parsing by derivatives."""
