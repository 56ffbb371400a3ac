"""Expressions as SQL text.

Each function takes SQL for its input and returns SQL, for `selectExpr` or `F.expr`.
Everything is made of built-in Spark functions. Text is parsed once, where the same
expression built column by column costs hundreds of calls from Python.
"""
