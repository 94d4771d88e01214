"""larder: product-catalogue and food-evidence analytics as Spark DataFrame operators."""
