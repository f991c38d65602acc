"""canopyflow: crown-phenology analytics and corpus preparation as Spark plans."""
