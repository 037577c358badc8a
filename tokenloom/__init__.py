"""tokenloom: text tokenization and text preparation as Spark DataFrame operators."""
