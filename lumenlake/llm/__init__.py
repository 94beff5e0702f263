"""Training-data operators: quality, mixing, near duplicates, decontamination, extraction, output.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames, keeps
whole texts, and treats a null text as an empty one unless its docstring says otherwise.
"""
