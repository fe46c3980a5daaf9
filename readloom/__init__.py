"""Sequencing-read analytics and assembly, and training-data preparation, as DataFrame operators."""
