"""Rule tables: values that are fixed by the definitions of the operators."""
