"""Folders of files as bounded streams."""
