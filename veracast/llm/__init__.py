"""Training-data operators: ten corpus-scale steps, each usable on any DataFrame with an id and a text column.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers its queries only where it is present.
"""
