"""tavuflow: a PySpark-native engine for tokenisation, labelled sequences and corpus analytics."""
