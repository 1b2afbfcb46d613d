"""Readers that turn files, texts and rule tables into DataFrames."""
